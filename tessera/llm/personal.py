"""Problem 4: personal information in free text, replaced by typed placeholders.

Method: a semi-Markov conditional random field. Candidate segments are whole spans (up to LONGEST characters) with a kind;
each is scored by weights of features of the whole span and of what stands before and after it; text outside segments
scores 0. Boundaries and kinds are chosen jointly by dynamic programming over the segments; the same lattice, summed
instead of maximised, gives the likelihood the weights are trained on. An entity is bounded in length, so the work is
linear in the length of the text.

The weights are trained here, on sentences this module makes up (invented names, reserved number ranges, and look-alike
material that is not personal: tickets, orders, ports, versions, decorators, products), at a fixed seed. TRAINING is the
number of sentences.

Kinds: email (spelled-out ones too), phone, id_number, address, person.

Defined results: null and empty texts come out as they are, with no spans. Repeated rows are treated alike. Overlapping
candidates: the best-scoring set of disjoint ones; of equal sets the one whose last span starts first.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "person")
LONGEST, TRAINING, EPOCHS, SEED = 160, 5000, 8, 11

#: Family names that a Chinese personal name starts with (fixed values).
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤祁桑景沐纪简温庄柯翟安柳俞章梅盛童颜聂詹岳齐邢路关焦鲁左涂耿阮季管卜裴苗凌喻牛葛伍申屠尤倪戚柏鲍骆霍柴洪包甘傅常施尚赖殷文樊曲兰翁康易乔庞代谷邬闵巫车穆麦房封符蓝佟卓荆褚娄宁滕解应冼牟边燕米屈池党宫胥华丛栾苟隋连仇单敖游瞿鞠邸晏匡从臧冉商卞巩门席廉姬戈谌艾成雍饶窦甄盖蒲郎岑薄靳晁麻费尉满欧刁寇郁项祝储竺缪浦狄皮时宗乐花楚沙阚那辛茅仲伊宣郗隗冀尧农晋步隆师权桓丰巢蒯强揭沃蔚幸司阳占濮查阙訾苑阎肇逄亓鄢鲜洛"
#: Family names of two characters (fixed values).
COMPOUND = "欧阳 司马 诸葛 上官 司徒 东方 独孤 南宫 万俟 闻人 夏侯 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 鲜于 司空 闾丘 令狐 端木 轩辕 呼延 东郭 南门 百里 西门 拓跋 第五 公西 左丘 梁丘 谷梁 羊舌 微生 乐正 漆雕 巫马 壤驷 公良 夹谷 段干 叶赫 纳兰 爱新".split()
#: Words that make an address (fixed values).
STREET = "Street|St|Road|Rd|Lane|Ln|Close|Avenue|Ave|Terrace|Drive|Dr|Way|Court|Ct|Place|Pl|Square|Sq|Crescent|Boulevard|Blvd|Row|Gardens|Grove|Hill|Mews|Walk|Parade|Highway|Alley"
UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Floor|Bldg)\s?#?\w{1,5}"
UP, LOW = "A-ZÀ-ÖØ-ÞĀ-Ž", "a-zà-öø-ÿā-ž"
CAP = rf"[{UP}][{LOW}]+(?:[-'’][{UP}]?[{LOW}]+)*"
#: Capitalised words of other scripts with letter case, and what may stand between the parts of a name (fixed values).
OTHER = "(?:[А-ЯЁІЇЄҐЎ][а-яёіїєґў]+|[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰς]+)(?:-(?:[А-ЯЁІЇЄҐЎ]|[Α-Ω])[а-яёіїєґўα-ωάέήίόύώς]+)?"
PARTICLE = "(?:de la|de los|de las|van der|van den|von der|de|da|di|del|della|du|dos|das|la|le|van|von|zu|ter|ten|bin|ibn|al|el|y|Ní|Nic|Ó|Ua|Mac|Mc|af|av)"
TITLE = r"(?:Dr|Prof|Mr|Mrs|Ms|Miss|Mx|Sir|Herr|Frau|Professor|Doctor)"
AT, DOT = r"(?:\s*[\(\[{<]\s*(?:at|ät|AT|At)\s*[\)\]}>]\s*|\s+(?:at|AT)\s+|\s*艾特\s*)", r"(?:\s*[\(\[{<]\s*(?:dot|DOT|Dot|punkt)\s*[\)\]}>]\s*|\s+(?:dot|DOT)\s+|\s*点\s*)"
H = "一-鿿"
#: What people are introduced by, where a name may stand in lower case (fixed values).
CUES = "friend colleague manager boss teacher neighbour neighbor sister brother cousin wife husband partner daughter son mother father aunt uncle landlord dentist doctor".split()

#: What may follow a street: nothing, a full stop, a unit, a place, a place with its code; each is a candidate of its own.
PARTS = ["", r"\.", rf"\.?,? {UNIT}", rf"\.?(?:,? {UNIT})?, {CAP}(?: {CAP}){{0,2}}", rf"\.?(?:,? {UNIT})?, {CAP}(?: {CAP}){{0,2}},?(?: [A-Z]{{2}})? \d{{4,6}}"]

#: What may be an entity: (kind, name of the shape, pattern). Wide on purpose: the model decides.
SHAPES = [
    ("email", "plain", re.compile(r"(?<![\w.+@-])[A-Za-z0-9][\w.+-]*[@＠](?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@])")),
    ("email", "spelled", re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*(?:{AT}|@)(?:[A-Za-z0-9-]+(?:{DOT}|\.))+[A-Za-z]{{2,}}\b")),
    ("phone", "digits", re.compile(r"(?<![A-Za-z0-9_.:/@#-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?)?\d{2,11}(?:[ .-]\d{2,8}){0,5}(?![A-Za-z0-9_:/%]|[.-]\d)")),
    ("id_number", "citizen", re.compile(r"(?<![A-Za-z0-9_-])\d{17}[\dXx](?![A-Za-z0-9_-])")),
    ("id_number", "social", re.compile(r"(?<![A-Za-z0-9_-])\d{3}[- ]\d{2}[- ]\d{4}(?![A-Za-z0-9_-])")),
    ("id_number", "insurance", re.compile(r"(?<![A-Za-z0-9_-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?![A-Za-z0-9_-])")),
    ("id_number", "run", re.compile(r"(?<![A-Za-z0-9_.-])(?:[A-Z]{1,3})?\d{7,17}[A-Z]?(?![A-Za-z0-9_-])")),
    *(("address", f"street{n}", re.compile(rf"(?:{UNIT},? )?(?<![A-Za-z0-9_.-])\d{{1,5}}[A-Za-z]? (?:{CAP} ){{1,3}}(?:{STREET})\b{rest}")) for n, rest in enumerate(PARTS)),
    ("address", "joined", re.compile(rf"{CAP}(?:straße|strasse|weg|gasse|allee|platz|ring|damm|ufer|str\.)\s\d{{1,4}}[a-z]?(?:, \d{{4,5}} {CAP}(?: {CAP})?)?")),
    ("address", "han", re.compile(rf"(?=((?:[{H}]{{2,4}}省)?(?:[{H}]{{2,4}}市)?(?:[{H}]{{2,4}}[区县镇乡])?[{H}]{{1,5}}?(?:大道|路|街|道|巷|弄|胡同)\d{{1,5}}[号弄](?:\d{{1,4}}[栋幢号座楼])?(?:\d{{1,3}}单元)?(?:\d{{1,3}}[楼层])?(?:\d{{1,5}}[室户])?))")),
    ("person", "titled", re.compile(rf"\b{TITLE}\.? {CAP}(?: {CAP})?")),
    ("person", "pair", re.compile(rf"(?<![\w.-])(?={CAP}(?: [A-Z]\.)? ({CAP}))(?P<s>{CAP}(?: [A-Z]\.)? {CAP})(?![\w-])")),
    ("person", "initial", re.compile(rf"(?<![\w.-]){CAP} [A-Z]\.(?![\w])")),
    ("person", "turned", re.compile(rf"(?<![\w.-]){CAP}, {CAP}(?![\w-])")),
    ("person", "capitals", re.compile(r"(?<![\w.-])[A-Z]{3,} [A-Z]{3,}(?![\w-])")),
    ("person", "parts", re.compile(rf"(?<![\w.-]){CAP}(?: {CAP})? {PARTICLE} {CAP}(?: {CAP})?(?![\w-])")),
    ("person", "other", re.compile(rf"(?<![\w.-]){OTHER}(?: {OTHER}){{1,2}}(?![\w-])")),
    ("person", "cued", re.compile(rf"(?=\b(?i:{'|'.join(CUES)})(?: is| was| named| called|:|,)? (?P<s>[{LOW}]{{2,14}} [{LOW}]{{2,14}})(?![\w-]))")),
    ("address", "box", re.compile(rf"\b(?:P\.? ?O\.? ?Box|Postfach|PO Box) \d{{1,6}}(?:, {CAP}(?: {CAP})?(?: \d{{4,6}})?)?")),
]
#: Shapes that need a look only where this occurs.
GATES = {
    "plain": re.compile("[@＠]"), "spelled": re.compile(r"[@({\[<]|\s(?:at|AT)\s|艾特"), "digits": re.compile(r"\d\d"), "citizen": re.compile(r"\d{17}"), "social": re.compile(r"\d{3}[- ]\d"), "insurance": re.compile(r"[A-Z]{2} ?\d\d"), "run": re.compile(r"\d{7}"),
    "street": re.compile(rf"\d[A-Za-z]? [{UP}]"), "joined": re.compile(r"[a-zß.] \d"), "han": re.compile(r"[路街道巷弄同]\d"), "box": re.compile("[Bb]ox|fach"), "titled": re.compile(rf" [{UP}]"), "initial": re.compile(r" [A-Z]\."), "turned": re.compile(rf", [{UP}]"), "capitals": re.compile("[A-Z]{3} [A-Z]{3}"),
    "pair": re.compile(rf"[{LOW}.] [{UP}]"), "parts": re.compile(rf" {PARTICLE} [{UP}]"), "other": re.compile("[а-яёα-ωά-ώ]"), "cued": re.compile(rf"\b(?:{'|'.join(CUES)})\b", re.I),
}
#: A Chinese name: a family name with what follows it.
_ODD = [c for c in COMPOUND if c[0] not in SURNAMES]
HAN_NAME = re.compile(rf"(?=([{SURNAMES}][{H}]{{1,3}}|(?:{'|'.join(_ODD)})[{H}]{{1,2}}))")
RUN = re.compile(rf"(?<![\w.-]){CAP}(?: {CAP}){{2,}}")
CAP_WORD = re.compile(CAP)
FAMILY = frozenset(SURNAMES)
AFTER = re.compile(rf"\s*([A-Za-z]+|[{H}]{{1,2}}|\d+|[^\w\s])")
LETTERS, TAIL_HAN, HEAD_HAN = re.compile("[A-Za-z]+"), re.compile(f"[{H}]$"), re.compile(f"[{H}]")
CELL_LEFT, CELL_RIGHT, BAR_LEFT, BAR_RIGHT = re.compile(r"[|,⏎]\s*$"), re.compile(r"\s*[|\n]"), re.compile(r"\|\s*$"), re.compile(r"\s*\|")
KEY, DIGITS, YEAR, BIRTH, STARTS = re.compile(r'"(\w+)":\s*"$'), re.compile(r"\d+"), re.compile(r"(19|20)\d\d[-./]"), re.compile(r"(19|20)\d\d(0[1-9]|1[0-2])([0-2]\d|3[01])"), re.compile(r"[.!?。！？:]\s*$")
UNITS = re.compile(r"[ ]?(?:%|条|个|件|点|号|页|items|rows|pages|units|entries|cases|percent)")
UNIT_NEXT, CODE_NEXT, PLACE_NEXT = re.compile(rf",? {UNIT}"), re.compile(r",? (?:[A-Z]{2} )?\d{4,6}\b"), re.compile(rf", {CAP}(?: {CAP})?(?: \d{{4,6}}|\s*[.,;。，；\n|\"]|$)")
STREET_END, CAP_LEFT, CAP_RIGHT, CAPITALS = re.compile(rf"(?:{STREET})\.?$"), re.compile(rf"{CAP} $"), re.compile(rf" {CAP}"), re.compile("[A-Z]+")


def last_token(before: str) -> str:
    """The last run of ASCII letters or digits, the last two Chinese characters or the last sign, in lower case; ^ for none."""
    before = before.rstrip()
    n = len(before)
    if not n:
        return "^"
    ch = before[-1]
    if "一" <= ch <= "鿿":
        return before[-2:] if n > 1 and "一" <= before[-2] <= "鿿" else ch
    if ch.isdecimal():
        at = n - 1
        while at and before[at - 1].isdecimal():
            at -= 1
        return before[at:]
    if ch.isascii() and ch.isalpha():
        at = n - 1
        while at and before[at - 1].isascii() and before[at - 1].isalpha():
            at -= 1
        return before[at:].lower()
    return "^" if ch.isalnum() or ch == "_" else ch


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, shape) of the segments that are considered."""
    out, open_ = set(), {}
    for kind, shape, pattern in SHAPES:
        gate = shape.rstrip("01234")
        if gate not in open_:
            open_[gate] = GATES[gate].search(text) is not None
        if not open_[gate]:
            continue
        for m in pattern.finditer(text):
            start, end = m.span(1) if shape == "han" else m.span("s") if shape in ("pair", "cued") else m.span()
            if shape == "cued" and not COMMON.isdisjoint(m["s"].split()):
                continue
            if 0 < end - start <= LONGEST:
                out.add((start, end, kind, shape))
    if not text.isascii():
        for m in HAN_NAME.finditer(text):
            start, most = m.start(1), m.end(1) - m.start(1)
            out |= {(start, start + n, "person", f"han{n}") for n in range(2 if text[start] in FAMILY else 3, most + 1)}
    if open_["pair"]:
        for m in RUN.finditer(text):  # pairs inside longer runs of capitalised words
            spans = [(m.start() + w.start(), m.start() + w.end()) for w in CAP_WORD.finditer(m[0])]
            out |= {(a[0], b[1], "person", "pair") for a, b in zip(spans, spans[1:], strict=False)}
    return sorted(out, key=lambda c: (c[1], c[0], c[2]))


def features(text: str, start: int, end: int, kind: str, shape: str) -> list[str]:
    """Features of the whole span with its surroundings."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 16]
    a = AFTER.match(after)
    left, right = last_token(before), a[1].lower() if a else "$"
    tail = before.split("\n")[-1]
    head = after.split("\n")[0]
    digits = sum(map(str.isdigit, span))
    k = f"{kind}:{shape}:"
    out = [k, f"{kind}<{left}", f"{kind}>{right}", f"{k}n{min(len(span), 40) // 3}", f"{k}d{digits}"]
    words = [w.lower() for w in LETTERS.findall(before)[-3:]]
    if len(words) > 1:
        out.append(f"{kind}<<{words[-2]} {words[-1]}")
    out += [f"{kind}<~{w}" for w in words]
    if TAIL_HAN.search(before):
        out += [f"{kind}<h{before[-n:]}" for n in (1, 2, 3)]
    if HEAD_HAN.match(after):
        out += [f"{kind}>h{after[:n]}" for n in (1, 2)]
    if not tail.strip(" -*") and not head.strip(" .,;。"):
        out.append(f"{kind}=line")
    if CELL_LEFT.search(before) and CELL_RIGHT.match(after) or BAR_LEFT.search(before) or (not tail.strip() and BAR_RIGHT.match(after)):
        out.append(f"{kind}=cell")
    m = KEY.search(before) if before.endswith('"') else None
    if m:
        out.append(f"{kind}=key:{m[1].lower()}")
    if kind in ("phone", "id_number"):
        out.append(k + DIGITS.sub(lambda m: str(len(m[0])), span)[:24])
        if span[0] == "+":
            out.append(k + "+")
        if YEAR.match(span):
            out.append(k + "year")
        if UNITS.match(after):
            out.append(k + "unit")
        if shape == "citizen":
            out.append(k + ("date" if BIRTH.match(span[6:14]) else "nodate"))
    if shape == "han":
        cut = re.search("[市区]", span)
        out += [f"{k}first{span[0]}", f"{k}head{cut.start() if cut else -1}", k + "full" * ("市" in span and "区" in span)]
    if shape.startswith("street"):
        more = text[end : end + 48]
        out.append(k + ("unit" if UNIT_NEXT.match(more) else "code" if CODE_NEXT.match(more) else "place" if PLACE_NEXT.match(more) else "ends"))
    if kind == "person" and shape in ("pair", "turned", "capitals"):
        low = [w.lower() for w in (CAP_WORD if shape != "capitals" else CAPITALS).findall(span)]
        out += [k + "plain"] * any(w in PLAIN for w in low) + [k + "plain2"] * all(w in PLAIN for w in low)
        if tail.strip(" -*") == "" or STARTS.search(tail):
            out.append(k + "starts")
        if STREET_END.search(span):
            out.append(k + "street")
        if CAP_LEFT.search(before) or CAP_RIGHT.match(after):
            out.append(k + "inrun")
    return out


#: Ordinary words that products, places and headings are named with (fixed values).
PLAIN = frozenset(
    "the a an and of to in on at by for from with as is are was be it its this that these those my your our his her their every each one another some any no not all both new old first last next "
    "blue red green white black grey golden silver copper iron amber granite river stone lake hill ridge pass port bay north south east west little great high low upper lower saint mount fort point "
    "birch cedar oak pine maple willow heron falcon fox bear wolf eagle swan otter lantern harbor harbour summit canyon valley meadow forest ocean island garden bridge tower gate castle "
    "release index update version edition studio cloud server engine suite office home address street road lane close avenue terrace square apt flat unit call text tel mobile contact login regards thanks best dear sincerely "
    "works wants keeps uses prefers decided concluded must send ship please cc write reach insurance identity number national number id monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "english german chinese french spanish python java markdown note notes chapter section page table figure part question answer what how when where why who which".split()
)
#: Words that do not stand in a name though they may follow a cue (fixed values).
FUNCTION = frozenset("about after again all also always been before being but can could did do does done down each even ever few for from get gets had has have here how if into just keep keeps let like made make many may me might more most much must near never next now off often only or other out over own said same say says see she should since so some still such take tell than then there they they too under until up us use used uses very via wants was we went were which while who will with without would yet you".split())
COMMON = PLAIN | FUNCTION
#: Ordinary words that stand around names in the made-up sentences (fixed values).
STRANGERS = "wrote asked told met saw called thanked invited joined left moved read sent showed helped answered before after during without whether because today yesterday tomorrow letter page draft note plan story photo lunch train garden winter spring meeting question parcel recipe and with for from by to about".split()


class SemiCRF:
    """Weights over features; decoding and training on the lattice of candidate segments."""

    def __init__(self) -> None:
        self.w: dict[str, float] = {}

    def lattice(self, text: str) -> list[tuple[int, int, str, list[str]]]:
        """The candidates with their features; a segment that several shapes propose is one with the features of all."""
        out: dict[tuple[int, int, str], list[str]] = {}
        for s, e, k, shape in candidates(text):
            own = features(text, s, e, k, shape)
            out[s, e, k] = list(dict.fromkeys(out.get((s, e, k), []) + own))
        return [(*key, feats) for key, feats in out.items()]

    def score(self, feats: list[str]) -> float:
        w = self.w
        return sum(w.get(f, 0.0) for f in feats)

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        """The best disjoint segments as (start, end, kind). ``best`` is kept at the ends of segments only."""
        ends, best, back = [0], [0.0], [None]
        for s, e, k, feats in self.lattice(text):
            at = _last(ends, s)
            value = best[at] + self.score(feats)
            if value > best[-1] + 1e-12:
                ends.append(e)
                best.append(value)
                back.append((at, s, e, k))
        out, i = [], len(ends) - 1
        while i > 0:
            at, s, e, k = back[i]
            out.append((s, e, k))
            i = at
        return out[::-1]

    def train(self, examples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4, seed: int = SEED) -> SemiCRF:
        """Stochastic gradient ascent of the conditional log-likelihood (forward and backward sums over the lattice)."""
        data = [(self.lattice(t), set(spans)) for t, spans in examples]
        order, rng, w = list(range(len(data))), random.Random(seed), self.w
        for epoch in range(epochs):
            rng.shuffle(order)
            step = rate / (1 + epoch)
            for n in order:
                segments, truth = data[n]
                if not segments:
                    continue
                scores = [self.score(f) for *_, f in segments]
                points = sorted({0, *[x for s, e, *_ in segments for x in (s, e)]})
                at = {p: i for i, p in enumerate(points)}
                size = len(points)
                ahead, behind = [-math.inf] * size, [-math.inf] * size
                ahead[0] = behind[-1] = 0.0
                by_end, by_start = defaultdict(list), defaultdict(list)
                for (s, e, *_), v in zip(segments, scores, strict=True):
                    by_end[at[e]].append((at[s], v))
                    by_start[at[s]].append((at[e], v))
                for i in range(1, size):
                    ahead[i] = _logsum([ahead[i - 1], *[ahead[s] + v for s, v in by_end[i]]])
                for i in range(size - 2, -1, -1):
                    behind[i] = _logsum([behind[i + 1], *[behind[e] + v for e, v in by_start[i]]])
                total = ahead[-1]
                for (s, e, k, feats), v in zip(segments, scores, strict=True):
                    p = math.exp(min(0.0, ahead[at[s]] + v + behind[at[e]] - total))
                    g = step * (((s, e, k) in truth) - p)
                    if abs(g) > 1e-5:
                        for f in feats:
                            w[f] = w.get(f, 0.0) * (1 - decay) + g
        return self


def _last(ends: list[int], start: int) -> int:
    from bisect import bisect_right

    return bisect_right(ends, start) - 1


def _logsum(values: list[float]) -> float:
    m = max(values)
    return m if m == -math.inf else m + math.log(sum(math.exp(v - m) for v in values))


def made_up(count: int, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with their spans. Names and places are random syllables; numbers are from ranges kept free for fiction."""
    r = random.Random(seed)
    pick = r.choice
    syllables = "ba be bri ca cor da del dor el en fa fen gar hal ho il is ja jo ka kel la li lo ma mar mi na nel no o per qui ra ri ro sa sel ta tor u va vi wen yo za".split()
    name = lambda: "".join(pick(syllables) for _ in range(r.randint(2, 3))).capitalize() + pick(["", "", "n", "s", "l", "ck", "rd", "th"])
    low = lambda: name().lower()
    coined = lambda: low() + pick(["", f"-{r.randint(1, 99)}", f"_{low()[:4]}"])
    d = lambda n: "".join(str(r.randint(0, 9)) for _ in range(n))
    place = lambda: pick(["Little ", "Port ", "", "", name() + " "]) + name()
    han = lambda n: "".join(pick("青禾星野望舒清越砚秋南枝若笙见山云岫明远子涵雨桐文博思远晓东志强丽华建国海燕春梅浩然") for _ in range(n))

    def entity(kind: str) -> str:
        if kind == "email":
            a = pick([f"{low()}.{low()}", f"{low()}{d(3)}", f"{low()}_{low()}{d(2)}", f"{low()}-{low()}", f"{low()}+notes", low()])
            dom, top = pick(["mail", "post", "inbox", "lab", "desk", "office", low()]), pick(["example", "test", "invalid", "org", "com", "net"])
            x = pick([f"{a}@{dom}.{top}"] * 5 + [f"{a} (at) {dom} (dot) {top}", f"{a}[at]{dom}.{top}", f"{a} at {dom} dot {top}", f"{a} [at] {dom} [dot] {top}"])
            return x.upper() if "@" in x and r.random() < 0.1 else x
        if kind == "phone":
            return pick([f"+44 20 7946 0{d(3)}", f"(020) 7946-0{d(3)}", f"07700 900{d(3)}", f"{pick(['202', '303', '415', '617', '212'])}-555-01{d(2)}", f"{pick(['202', '303', '415'])}.555.01{d(2)}", f"+1 ({pick(['202', '617'])}) 555-01{d(2)}", f"1{pick(['202', '303', '415'])}55501{d(2)}", f"010-0550{d(4)}", f"+86 21 0550 0{d(3)}", f"+61 491 570 {d(3)}", f"1{pick('3578')}{d(9)}", f"0{d(2)}-{d(8)}", f"+49 30 23125 {d(3)}"])
        if kind == "id_number":
            return pick([f"99{d(4)}{r.randint(1950, 2005)}{r.randint(1, 12):02}{r.randint(1, 28):02}{d(3)}{pick('0123456789X')}", f"9{d(2)}-{d(2)}-{d(4)}", f"987-65-432{d(1)}", f"QQ {d(2)} {d(2)} {d(2)} {pick('ABCD')}", f"QQ{d(6)}{pick('ABCD')}"])
        if kind == "address":
            if r.random() < 0.35:
                return f"{han(2)}市{han(2)}区{han(2)}{pick('路街')}{r.randint(1, 499)}号" + pick(["", f"{r.randint(1, 9)}单元", f"{r.randint(1, 20)}栋{r.randint(101, 2800)}室"])
            if r.random() < 0.2:
                return f"{name()}{pick(['straße', 'weg', 'gasse', 'allee'])} {r.randint(1, 99)}" + pick(["", f", 00{d(3)} {name()}"])
            street = f"{r.randint(1, 499)} {name()}{pick(['', ' ' + name(), ' Bank'])} {pick(['Street', 'St.', 'St', 'Road', 'Rd', 'Lane', 'Close', 'Avenue', 'Ave', 'Terrace'])}"
            return pick([street, f"Flat {r.randint(1, 40)}, {street}", f"{street}, Apt {r.randint(1, 30)}{pick('ABC')}", f"{street}, {name()}", f"{street}, Apt {r.randint(1, 30)}{pick('ABC')}, {place()} 00{d(3)}", f"{street}, {place()}"])
        if r.random() < 0.12:
            cyrillic = lambda: "".join(pick("ба ве го да ил ка ле мо ни ор па ри со та ур фе ян".split()) for _ in range(r.randint(2, 3))).capitalize() + pick(["", "в", "н", "й"])
            return pick([f"{name()} {pick(['de la', 'van', 'von', 'de', 'van der', 'Ní', 'al', 'di'])} {name()}", f"{name()}-{name()} {name()}", f"{cyrillic()} {cyrillic()}"])
        if r.random() < 0.35:
            if r.random() < 0.15:  # a family name of two characters, or two family names
                return pick([pick(COMPOUND) + han(pick([1, 2])), pick(SURNAMES) + pick(SURNAMES) + han(2)])
            return pick(pick(["祁桑景沐纪陆简王李张刘陈杨赵周吴", SURNAMES])) + han(pick([1, 2, 2, 2]))
        return pick([f"{name()} {name()}"] * 4 + [f"{pick(['Dr.', 'Prof.', 'Mr', 'Ms', 'Mrs', 'Dr'])} {name()}", f"{name()}, {name()}", f"{name()} {pick('ABCDEFGHJKLMNPRSTVW')}."])

    cues = {
        "email": ["my address is {}", "send the export to {}", "write to {} if the sync fails", "login: {}", "contact={}", "{} should get the weekly digest", "我的邮箱是 {}", "导出发到 {}", "同步失败请写信给 {}", "账号：{}", "<mailto:{}>", '"mail": "{}"'],
        "phone": ["call me on {}", "my number is {}", "tel {}", "mobile: {}", "text {} after six", "reach the desk at {}", "打我电话 {}", "手机号{}", "联系电话：{}", "有事拨 {} 找我", '"tel": "{}"'],
        "id_number": ["the form lists SSN {}", "ID no. {} is on page two", "insurance number {}", "identity number={}", "my national id is {}", "身份证号{}", "证件号码是 {}", "表格里填的身份证：{}", '"national_id": "{}"'],
        "address": ["I live at {}", "home address: {}", "the parcel goes to {}", "we meet at {}", "ship the printed copy to {}", "the office moved to {}", "我住在{}", "收件地址：{}", "打印件寄到{}", "办公室搬到{}", '"addr": "{}"'],
        "person": ["my manager is {}", "please loop in {} on the draft", "cc {} when the import ends", "{} owns this vault", "the notes were taken by {}", "I share this folder with {}", "as {} said in the call", "contact {} or me", "cc {} on it", "meet {} at noon", "{} asked for the summary", "记录人是{}", "我的同事{}负责这个仓库", "请抄送{}", "{}要这份结果", "{}说下周再看", "联系人：{}", '"name": "{}"'],
    }
    decoys = [
        lambda: f"see ticket {d(3)}-{d(5)} from 20{r.randint(10, 26)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"order 20{d(2)}-{d(5)} has {d(3)} items", lambda: f"build {d(1)}.{d(3)}.{d(1)} runs on 10.0.{d(1)}.{d(1)}", lambda: f"the trace id is {d(15)}", lambda: f"ratio {d(3)}:{d(3)} from {d(5)}-{d(5)} units",
        lambda: f"the package is @{low()}/core-{d(1)}", lambda: f"use the @{low()}.{low()} decorator on line {d(3)}", lambda: f"the hash starts with {d(3)}af{d(5)}", lambda: f"the {pick(['Blue', 'Amber', 'Silver', 'Granite', 'Golden'])} {pick(['Heron', 'Falcon', 'Birch', 'Pass', 'Lantern'])} index holds {d(5)} rows", lambda: f"{pick(['Granite', 'Copper', 'Silver', 'Amber'])} {pick(['Pass', 'Ridge', 'Birch', 'Harbor'])} is the release after {pick(['Silver', 'Golden'])} {pick(['Birch', 'Fox', 'Pine'])} {d(1)}",
        lambda: f"chapter {d(3)} Lane detection is the longest", lambda: f"订单 20{d(7)} 共 {d(3)} 件", lambda: f"见工单 {d(3)}-{d(5)}", lambda: f"端口 {d(5)} 保持打开", lambda: f"版本 {d(1)}.{d(3)}.{d(1)} 已发布", lambda: f"追踪编号 {d(15)}", lambda: f"第{d(3)}号规则不变", lambda: f"{han(2)}主题的配色编号 {d(5)}", lambda: f"port {d(5)} stays open", lambda: f"trace {d(18)}",
        lambda: f"the {pick(['strict', 'loose', 'broken'])} {pick(['query log', 'cover image', 'usage chart'])} of {coined()} merges {d(3)} rows", lambda: f"we moved the {pick(['sync job', 'folder scan'])} to {coined()} on day {d(3)}", lambda: f"e.g. {coined()} v{d(1)}.{d(2)}, before the next import starts", lambda: f"{pick(['周日', '明天', '下雨时'])}{pick(['妈妈', '老师', '小猫', '弟弟'])}{pick('念关买找放洗')}{pick(['黄叶', '白纸', '月饼', '门票', '钥匙'])}和{pick(['黄叶', '白纸', '红灯', '铅笔'])}",
        lambda: f"{pick(['标题索引', '目录扫描', '历史搜索', '关键词过滤'])}{pick(['负责合并', '限制了', '经常忽略', '不再显示'])}{d(3)}条{pick(['旧版的封面', '空白的表头', '同名的文件夹', '多余的链接'])}", lambda: f"{pick(['Works on', 'Keeps', 'Prefers', 'Must not export', 'Wants answers about'])} a {pick(['visible', 'nested'])} glossary page called {coined()}", lambda: f"{pick(['After', 'Within', 'Next to'])} the {pick(['Weekly Review', 'Chess Club', 'language course'])}, the {coined()} page waits", lambda: f"有{d(2)}个{pick(['', '！'])}", lambda: f"决定用 {coined()} 代替 {coined()} 处理导出脚本", lambda: f"共{d(3)}条",
    ]
    common = "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高间由问很最重并物手应战向头文体政美相见被利什二等产新己制身果加西斯月话合回特代内信表化老给世位次度门任常先海通教儿原东声提立及比员解水名真论处走义各入几口认条平系气题活尔更别打女变四神总何电数安少报才结反受目太量再感建务做接必场件计管期市直德资命山金指克许统区保至队形社便空决治展马科司五基眼书非则听白却界达光放强即像难且权思王象完设式色路记南品住告类求据程北边死张该交规万取拉格望觉术领共确传师观清今切院让识候带导争运笔余球鞋关窗户列表摘要标签模板原文"
    plain = lambda n: "".join(pick(common) for _ in range(n))
    decoys += [lambda: plain(r.randint(1, 6)) + pick(SURNAMES) + plain(r.randint(1, 6)), lambda: f"{pick(['不过', '随后', '因此', '爷爷', '妈妈'])}{plain(2)}{pick(['多余', '关', '白', '高', '常', '空白', '上'])}{plain(2)}{pick(['', '，', '！'])}", lambda: f"{plain(r.randint(2, 8))}{coined()}{plain(r.randint(2, 8))}", lambda: f"{pick(SURNAMES)}{plain(r.randint(2, 9))}"] * 2
    nouns = "代码片段 代码高亮 文件名称 文档目录 时间排序 常用标签 封面图片 符号列表 连接状态 应用设置 项目说明 解析结果 储存空间 查询结果 关键词表 路径前缀 万能模板 高级选项 白色背景 连续段落".split()  # begin like names
    decoys += [lambda: f"{pick(['', '备份时，', '导出后，', '昨天'])}{pick(nouns)}{pick(['负责', '负责拆分', '合并了', '常常忽略', '不再', '说明'])}{pick(['这个仓库', '旧表头', plain(3)])}"] * 2
    out = []
    for _ in range(count):
        text, spans = "", []

        def put(s: str) -> None:
            nonlocal text
            text += s

        for part in range(r.randint(1, 5)):
            if part:
                put(pick([". ", ". ", "，", "。", "; ", " and ", ", ", "\n", "！", "\n- ", ".\n\n"]))
            roll = r.random()
            if roll < 0.45:
                s = pick(decoys)()
                put(s[0].upper() + s[1:] if r.random() < 0.4 else s)
                continue
            if roll < 0.48:  # people in lower case, and what they do
                who, two = pick(CUES), [pick([low(), coined(), *"likes really tea enjoys walks asked kindly laughs bakes bread visits london fixed bikes plays chess sleeps well reads novels".split()]) for _ in range(2)]
                put(f"{pick(['my', 'our', 'the', 'her'])} {who} ")
                if r.random() < 0.5:
                    x = f"{low()} {low()}"
                    spans.append((len(text), len(text) + len(x), "person"))
                    put(x + pick([" called", " said hello", " has a key", ""]))
                else:
                    put(" ".join(two))
                continue
            if roll < 0.58:  # a row of a table, a signature
                put(pick(["\n", "\n\nRegards,\n", "\n\n此致\n", "\n\n-- \n", f"{d(3)} | ", "| "]))
                sep = pick([" | ", "\n", " | "])
                for n, kind in enumerate(r.sample(KINDS, r.randint(1, 4))):
                    put(sep if n else "")
                    x = entity(kind)
                    spans.append((len(text), len(text) + len(x), kind))
                    put(x)
                put(pick(["", f" | {coined()}", "\n"]))
                continue
            kind = pick(KINDS)
            cue = pick(cues[kind])
            if kind == "person" and r.random() < 0.3:  # a name among words that say nothing about it
                some = lambda: " ".join(pick(STRANGERS) for _ in range(r.randint(1, 3)))
                cue = pick([f"{some()} {{}} {some()}", f"{{}} {some()}", f"{some()} {{}}", f"{plain(r.randint(2, 5))}{{}}，{plain(3)}", f"{{}}{plain(3)}"])
            a, b = cue.split("{}")
            x = entity(kind)
            a = a[0].upper() + a[1:] if a and r.random() < 0.3 else a
            put(a)
            spans.append((len(text), len(text) + len(x), kind))
            put(x + b)
        put(pick(["", ".", "。"]))
        out.append((text, spans))
    return out


_trained: list[SemiCRF] = []


def model() -> SemiCRF:
    """The trained model, once per process."""
    if not _trained:
        _trained.append(SemiCRF().train(made_up(TRAINING)))
    return _trained[0]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder of its kind for each span."""
    out, at = [], 0
    for s, e, k in spans:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def values_of(memories: DataFrame, messages: DataFrame) -> DataFrame:
    """tbl, row_id, field, value of the three fields, repeated rows once."""
    pair = lambda field: F.struct(F.lit(field).alias("field"), F.col(field).alias("value"))
    m = memories.select(F.lit("memories").alias("tbl"), F.col("id").alias("row_id"), F.explode(F.array(pair("statement"), pair("quote"))).alias("v")).select("tbl", "row_id", "v.*")
    c = messages.select(F.lit("conversation_messages").alias("tbl"), F.col("message_id").alias("row_id"), F.lit("content").alias("field"), F.col("content").alias("value"))
    return m.unionByName(c)


def find(spark: SparkSession, values: DataFrame) -> DataFrame:
    """tbl, row_id, field, value with placeholders, spans (array of start, stop, kind; code points of the stored value)."""
    shared = spark.sparkContext.broadcast(model())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [shared.value.decode(v) if v else [] for v in frame["value"]]
            frame["value"] = [redact(v, s) if v else v for v, s in zip(frame["value"], got, strict=True)]
            frame["spans"] = [[{"start": s, "stop": e, "kind": k} for s, e, k in own] for own in got]
            yield frame

    return values.mapInPandas(run, "tbl string, row_id string, field string, value string, spans array<struct<start:int,stop:int,kind:string>>")


def found(spark: SparkSession, memories: DataFrame, messages: DataFrame) -> DataFrame:
    """p4_found: tbl, row_id, field and kind of what the operator finds."""
    got = find(spark, values_of(memories, messages))
    return got.select("tbl", "row_id", "field", F.explode("spans.kind").alias("kind")).distinct()
