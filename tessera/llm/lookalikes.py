"""Problem 5: one consistent form for text that looks the same.

Method: look-alike classes are computed transitively by union-find over code points and strings, each class gets its most
frequent ordinary member as representative, and texts are rewritten greedily (leftmost, longest) by a multi-pattern
automaton.

The nodes are the code points and base-plus-accent strings that occur in the corpus (counted over all texts; their number
is bounded by Unicode, not by the data, which is why the counts may be collected and the automaton broadcast). Edges:
compatibility decompositions of letters, digits, ligatures and radicals; canonical compositions; spaces of special width;
invisible characters (to the empty string); and look-alike letters across scripts (LETTERS).
An ordinary member is one that needs no rewriting by itself; of several the most frequent one represents, ties by code
point. Across scripts the Latin members represent, and only within words that have a Latin letter: words wholly in
another script, and single Greek symbols, stay.

Kinds reported: fullwidth, accent, invisible, space, stylised, lookalike. Kept as they are: Chinese punctuation, joiners
and variation selectors inside emoji, composed accented letters.

Defined results: null stays null and empty stays empty, with no kinds. Repeated rows of an id are rewritten alike.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of other scripts and the Latin letters they look like (fixed values).
LETTERS = {
    "cyrillic": "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj ԁd ԛq ԝw һh ӏl ҽe ѵv кk тt мm нh вb",
    "greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ιi κk ρp υu χx ϲc ϳj",
    "armenian": "օo սu ոn հh ցg զq յj ՏS ՍU ՕO",
    "cherokee": "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ",
}
LOOKS = {pair[0]: pair[1] for pairs in LETTERS.values() for pair in pairs.split()}

SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufe00\ufe01\ufe02\ufe0e\ufe0f\ufeff\uffa0"
)
ACCENTS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\ufe20-\ufe2f"
#: Radicals of the supplement block, which have no decomposition, and the characters they stand for (fixed values).
RADICALS = (
    "⺁厂 ⺂乛 ⺃乚 ⺄乙 ⺅亻 ⺆冂 ⺇几 ⺈刀 ⺉刂 ⺊卜 ⺋㔾 ⺌小 ⺍小 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺔彑 ⺕彐 ⺖忄 ⺗㣺 ⺘扌 ⺙攵 ⺛旡 ⺜日 ⺝月 ⺞歺 ⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺥爫 ⺦丬 ⺧牛 ⺨犭 ⺩王 ⺪疋 ⺫目 "
    "⺬示 ⺭礻 ⺮竹 ⺯糸 ⺰纟 ⺱罓 ⺲罒 ⺶羊 ⺷羊 ⺹耂 ⺺肀 ⺻聿 ⺼肉 ⺽臼 ⺾艹 ⺿艹 ⻀艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻇角 ⻈讠 ⻉贝 ⻊足 ⻋车 ⻌辶 ⻍辶 ⻎辶 ⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻕阜 ⻖阝 ⻗雨 ⻘青 ⻙韦 ⻚页 "
    "⻛风 ⻜飞 ⻝食 ⻞食 ⻟飠 ⻠饣 ⻡首 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀 ⻳龟"
)
STANDS_FOR = {pair[0]: pair[1] for pair in RADICALS.split()}
#: What a text must contain to need a look: evaluated in the JVM, so ordinary texts never reach Python.
SUSPECT = (
    "[\\x{AD}\\x{A0}\\x{300}-\\x{36F}\\x{370}-\\x{52F}\\x{531}-\\x{587}\\x{61C}\\x{115F}\\x{1160}\\x{13A0}-\\x{13F4}\\x{1680}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180E}"
    "\\x{1AB0}-\\x{1AFF}\\x{1D00}-\\x{1DFF}\\x{2000}-\\x{200F}\\x{202A}-\\x{202F}\\x{205F}-\\x{206F}\\x{2100}-\\x{214F}\\x{2460}-\\x{24FF}\\x{2E80}-\\x{2FDF}\\x{3000}\\x{3164}"
    "\\x{F900}-\\x{FAFF}\\x{FB00}-\\x{FB06}\\x{FB13}-\\x{FB17}\\x{FE00}-\\x{FE0F}\\x{FE20}-\\x{FE2F}\\x{FEFF}\\x{FF10}-\\x{FF19}\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}\\x{FFA0}"
    "\\x{1D400}-\\x{1D7FF}\\x{1F110}-\\x{1F16F}\\x{2F800}-\\x{2FA1F}\\x{E0001}-\\x{E01EF}]"
)
MARK = re.compile(f"[{ACCENTS}]")
WORD = re.compile("[^\\W\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\U00020000-\U000323af]+")
JOINED = re.compile("(?<=[\u00a9\u00ae\u203c-\u3299\U0001f000-\U0001faff\ufe0f])[\u200d\ufe0e\ufe0f]+|(?<=[0-9#*])\ufe0f(?=\u20e3)")


def plain_form(text: str) -> str:
    """The ordinary form of a styled letter, ligature or radical."""
    return STANDS_FOR.get(text) or ud.normalize("NFKC", text)


def kind_of(ch: str) -> str | None:
    """The kind of a single character that is rewritten everywhere, else None."""
    if ch in INVISIBLE or "\U000e0001" <= ch <= "\U000e01ef":
        return "invisible"
    if ch in SPACES:
        return "space"
    if "０" <= ch <= "９" or "Ａ" <= ch <= "Ｚ" or "ａ" <= ch <= "ｚ":
        return "fullwidth"
    if MARK.match(ch):
        return "accent"
    if ch < "\u1d00":
        return None
    form = plain_form(ch)
    if form == ch or not form:
        return None
    name = ud.name(ch, "")
    if name.startswith(("KANGXI RADICAL", "CJK RADICAL", "CJK COMPATIBILITY IDEOGRAPH", "MATHEMATICAL ", "LATIN SMALL LIGATURE", "ARMENIAN SMALL LIGATURE", "CIRCLED LATIN", "SQUARED LATIN", "PARENTHESIZED LATIN")):
        return "stylised" if all(c.isalnum() for c in form if c not in "()") else None
    if "\u2102" <= ch <= "\u2149" and len(form) == 1 and form.isalpha() and ch not in "\u2103\u2109\u2126\u2135\u2136\u2137\u2138":
        return "stylised"
    return "stylised" if ch in "\u212a\u212b" else None


class Classes:
    """Union-find over strings, with counts; representatives and the rewriting automaton."""

    def __init__(self, singles: dict[str, int], accented: dict[str, int]) -> None:
        self.parent: dict[str, str] = {}
        self.count = Counter(singles)
        self.count.update(accented)
        for ch in singles:
            kind = kind_of(ch)
            if kind == "invisible":
                self.join(ch, "")
            elif kind == "space":
                self.join(ch, " ")
            elif kind in ("fullwidth", "stylised"):
                self.join(ch, plain_form(ch))
            if ch in LOOKS:
                self.join(ch, LOOKS[ch])
        for pair in accented:
            self.join(pair, ud.normalize("NFC", pair))
        members: dict[str, list[str]] = {}
        for x in list(self.parent):
            members.setdefault(self.find(x), []).append(x)
        self.everywhere: dict[str, str] = {}
        self.in_latin: dict[str, str] = {}
        for own in members.values():
            ordinary = [x for x in own if not (len(x) == 1 and kind_of(x)) and not MARK.search(x) and x not in LOOKS] or [x for x in own if x not in LOOKS] or own
            best = min(ordinary, key=lambda x: (-self.count.get(x, 0), x))
            for x in own:
                if x in LOOKS:
                    self.in_latin[x] = best
                elif x != best:
                    # a letter styled in another script keeps its script: only its plain form is Latin's look-alike
                    own_form = plain_form(x) if x and len(x) <= 2 and kind_of(x[0]) in ("stylised", "fullwidth") else best
                    self.everywhere[x] = own_form if own_form in LOOKS else best
        self.machine = None

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"machine": None}

    def automaton(self):
        if self.machine is None:
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for k, v in self.everywhere.items():
                if k:
                    self.machine.add_word(k, (k, v))
            self.machine.make_automaton()
        return self.machine

    def rewrite(self, text: str) -> tuple[str, set[str]]:
        """The consistent form and the kinds of what was rewritten."""
        kinds: set[str] = set()
        kept = {i for m in JOINED.finditer(text) for i in range(*m.span())}
        out, at = [], 0
        if len(self.automaton()):
            for end, (k, v) in self.automaton().iter_long(text):
                begin = end - len(k) + 1
                if begin in kept:
                    continue
                out += [text[at:begin], v]
                at = end + 1
                kinds.add("accent" if len(k) > 1 else kind_of(k) or "stylised")
        text = "".join([*out, text[at:]])
        if MARK.search(text):  # accents left: on bases without a composed form in the corpus' classes
            kinds.add("accent")
            text = ud.normalize("NFC", text) if ud.normalize("NFC", text) != text else text
        if self.in_latin and not text.isascii():

            def plain(m: re.Match) -> str:
                w = m[0]
                if not w.isascii() and any(c in self.in_latin for c in w) and any("LATIN" in ud.name(c, "") for c in w if c.isalpha() and c not in self.in_latin):
                    kinds.add("lookalike")
                    return "".join(self.in_latin.get(c, c) for c in w)
                return w

            text = WORD.sub(plain, text)
        return text, kinds


def values_of(blocks: DataFrame, memories: DataFrame) -> DataFrame:
    """tbl, row_id, field, value of the three fields, each value of a row once per scan (one pass over each table)."""
    pair = lambda field: F.struct(F.lit(field).alias("field"), F.col(field).alias("value"))
    b = blocks.select(F.lit("blocks").alias("tbl"), F.col("block_id").alias("row_id"), F.explode(F.array(pair("text"), pair("heading_path"))).alias("v")).select("tbl", "row_id", "v.*")
    m = memories.select(F.lit("memories").alias("tbl"), F.col("id").alias("row_id"), F.lit("statement").alias("field"), F.col("statement").alias("value"))
    return b.unionByName(m)


def count_characters(values: DataFrame) -> DataFrame:
    """what (a code point, or base times 2^21 plus accent) and n, over all values; summed per batch before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for frame in frames:
            points = np.frombuffer("\n".join(frame["value"]).encode("utf-32-le", "surrogatepass"), np.uint32)
            n = np.bincount(points)
            seen = np.flatnonzero(n)
            total.update(dict(zip(seen.tolist(), n[seen].tolist(), strict=True)))
            marks = np.flatnonzero((points >= 0x300) & ((points <= 0x36F) | ((points >= 0x1AB0) & (points <= 0x1AFF)) | ((points >= 0x1DC0) & (points <= 0x1DFF)) | ((points >= 0xFE20) & (points <= 0xFE2F))))
            marks = marks[marks > 0]
            pairs = points[marks - 1].astype(np.int64) * (1 << 21) + points[marks]
            total.update(dict(zip(*(x.tolist() for x in np.unique(pairs, return_counts=True)), strict=True)))
        yield pd.DataFrame({"what": list(total), "n": list(total.values())}, dtype="int64")

    return values.where("value IS NOT NULL AND value <> ''").select("value").mapInPandas(run, "what long, n long").groupBy("what").agg(F.sum("n").alias("n"))


def fit(values: DataFrame) -> Classes:
    """The classes of the corpus. Collected: one number per code point and accented pair that occurs."""
    singles, accented = {}, {}
    for what, n in count_characters(values).collect():
        if what < 1 << 21:
            singles[chr(what)] = n
        else:
            accented[chr(what >> 21) + chr(what & ((1 << 21) - 1))] = n
    singles = {c: n for c, n in singles.items() if not 0xD800 <= ord(c) <= 0xDFFF}
    return Classes(singles, accented)


def canonical(spark: SparkSession, values: DataFrame) -> DataFrame:
    """tbl, row_id, field, value (rewritten) and kinds (array, empty if unchanged) of every value."""
    shared = spark.sparkContext.broadcast(fit(values))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [shared.value.rewrite(v) for v in frame["value"]]
            frame["value"] = [t for t, _ in done]
            frame["kinds"] = [sorted(k) for _, k in done]
            yield frame

    suspect = F.coalesce(F.col("value").rlike(SUSPECT), F.lit(False))
    odd = values.where(suspect).mapInPandas(run, "tbl string, row_id string, field string, value string, kinds array<string>")
    return odd.unionByName(values.where(~suspect).withColumn("kinds", F.array().cast("array<string>")))


def found(spark: SparkSession, blocks: DataFrame, memories: DataFrame) -> DataFrame:
    """p5_found: tbl, row_id and field of the values that the operator had to rewrite."""
    values = values_of(blocks, memories)
    return canonical(spark, values).where(F.size("kinds") > 0).select("tbl", "row_id", "field").distinct()
