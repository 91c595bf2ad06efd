"""Questions brought to their plain form: the words of asking go, the words of fact stay.

A question is divided into known words of asking and the text between them (longest word first). What becomes of a word depends
on its kind and its neighbours, decided in one walk over the pieces; no pattern sees the result of another. A batch of questions
is small next to the corpus, so this runs as one Arrow UDF.

Defined results: null and blank questions give an empty text; a question of nothing but asking stays as it is (compatibility
form); ties do not occur.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions import text as T

#: Words of asking by kind (fixed values).
WORDS = {
    "polite": "比如说 比方说 我想问一下 我想问问 我想了解一下 我想了解 想问一下 想了解一下 能不能帮我 可以帮我 麻烦帮我 请帮我 请问一下 请问",
    "unsure": "好像 似乎 印象中 记得 感觉 我好像 我似乎 我印象中 我记得 我感觉",
    "some": "有一些 有些 用一些 存在一些 一些",
    "about": "对于 关于",
    "manner": "什么样 怎么样 怎样",
    "how": "怎么 如何",
    "loose": "应该是 应当是 其实是 以及 它的 他的 她的 它们的 他们的 中存在的 意义何在 如何在 是如何在",
    "group": "团队 我们 他们",
    "those": "这些 上述 以上",
    "be": "是 为",
    "of": "的",
    "and": "和",
    "like": "等对比",
    "exact": "具体",
    "noun": "分表 对比 详情 方案 规则 机制 流程 配置 实现 区别 优缺点 内容",
    "state": "情况",
}
#: Words of a question about what a percentile is used for, and those that may stand beside them (fixed values).
USAGE = "场景 业务 项目 作用 调优 应用 意义".split()
GENERIC = "什么样 怎么样 如何 怎么 哪些 什么 公司 业务 项目 作为 指标 进行 调优 优化 场景 作用 应用 使用 这个 这种 它们 他们 以及 意义 价值 实际 具体 一下 在 的 中 是 去 下 他 它 对 又 有 呢 吗 和 与 及 了 用 到 做 上".split()
MARKS = "，,、；;：:？?。！!"
EDGE = " \t\r\n" + MARKS
#: What a definition question has before or after the name it asks for (fixed values).
ASKS_BEFORE = ("什么是", "何为")
ASKS_AFTER = ("是什么", "什么意思", "的定义是什么", "的定义", "的全称是什么", "的全称")

KIND = {word: kind for kind, words in WORDS.items() for word in words.split()}
PIECE = re.compile("|".join(sorted(map(re.escape, KIND), key=lambda w: (-len(w), w))))
PERCENT = re.compile(r"(?:p(\d{1,2}(?:\.\d+)?)|(\d{1,2}(?:\.\d+)?)\s*%?\s*(?:百分位|分位)数?)(?![\d.])", re.I)
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.-]*")


def pieces(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the pieces in order; what is no word of asking has the kind ''."""
    out, at = [], 0
    for m in PIECE.finditer(text):
        if m.start() > at:
            out.append(("", text[at : m.start()]))
        out.append((KIND[m[0]], m[0]))
        at = m.end()
    return [*out, ("", text[at:])] if at < len(text) else out


def without_lead(own: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The pieces after an uncertain or topical beginning."""
    for kinds in (("unsure",), ("some",), ("about",)):
        n = 0
        while n < len(own) and (own[n][0] in kinds or kinds == ("unsure",) and n and not own[n][1].strip(" ，,、")):
            n += 1
        own = own[n:]
    return own


def percentile_usage(text: str) -> str | None:
    """The percentile (as ``99分位``) that a question of generic words asks the use of, else null."""
    text = unicodedata.normalize("NFKC", text or "").strip().replace("九十九", "99").replace("九九", "99")
    first = PERCENT.match(text)
    if not first:
        return None
    number = (first[1] or first[2]).lstrip("0") or "0"
    number = number.rstrip("0").rstrip(".") if "." in number else number
    rest = PERCENT.sub("", text)
    if not any(w in rest for w in USAGE):
        return None
    for word in sorted(GENERIC, key=len, reverse=True):
        rest = rest.replace(word, " ")
    return f"{number}分位" if not rest.strip(EDGE) else None


def plain_question(q: str | None) -> str:
    """The question without words of asking; the compatibility form of the whole if nothing is left. Null gives ''."""
    whole = unicodedata.normalize("NFKC", (q or "").strip())
    own = [p for p in without_lead(pieces(whole)) if p[0] != "polite"]
    usage = percentile_usage("".join(t for _, t in own))
    if usage:
        return usage
    kept: list[tuple[str, str]] = []
    n = 0
    while n < len(own):
        kind, text = own[n]
        after = own[n + 1 :]
        n += 1
        if kind == "manner":  # how something is: goes with the verb before and the particle after it
            if kept and kept[-1][0] == "be":
                kept.pop()
            if after and after[0][0] == "of":
                n += 1
            kept.append(("gap", " "))
        elif kind == "how" and after and re.match(r"[一-鿿A-Za-z0-9]", after[0][1]):
            if kept and kept[-1][0] == "be":
                kept.pop()
            if kept and kept[-1][0] == "group":
                kept.pop()
        elif kind in ("loose", "about"):
            kept.append(("gap", " "))
        elif kind == "those":  # those (nouns') details are the details
            ahead = [p for p in after[:4]]
            stop = next((i for i, p in enumerate(ahead) if p[1] == "详情"), None)
            if stop is None or any(p[0] not in ("noun", "state", "of", "exact") for p in ahead[:stop]):
                kept.append((kind, text))
            else:
                n += stop
        elif kind == "of" and (not "".join(t for _, t in after).strip(EDGE) or after[0][0] == "noun"):
            continue
        elif kind == "and" and (not kept or kept[-1][1][-1:] in "，,；;") and after and re.match("[一-鿿]", after[0][1]):
            continue
        elif kind != "like":
            kept.append((kind, text))
    while kept and (kept[-1][0] in ("of", "gap") or not kept[-1][1].strip(EDGE)):
        kept.pop()
    if len(kept) > 1 and kept[-1][1] == "详情":
        kept[-2] = (kept[-2][0], kept[-2][1].rstrip("，,；; "))
    out = " ".join("".join(t for _, t in kept).split())
    tidy: list[str] = []
    for ch in out:
        if ch in MARKS and tidy and tidy[-1] == " ":
            tidy.pop()
        if tidy and tidy[-1] in MARKS and (ch == " " or ch == tidy[-1]):
            continue
        tidy.append(ch)
    return "".join(tidy).strip(EDGE) or whole


def definition_subject(q: str | None) -> str | None:
    """The bare identifier (up to four words of ASCII) that a definition question asks for, else null."""
    text = (q or "").strip().rstrip("？? ")
    lead = sorted(["请", "问", "问一下", "请问", "请问一下", "我想问", "我想问一下", "我想了解", "我想了解一下"], key=len, reverse=True)
    for _ in range(2):
        text = next((text[len(w) :] for w in lead if text.startswith(w)), text).lstrip(" ,，:：")
    before = next((w for w in ASKS_BEFORE if text.startswith(w)), "")
    after = "" if before else next((w for w in sorted(ASKS_AFTER, key=len, reverse=True) if text.endswith(w)), "")
    if not before and not after:
        return None
    words = text[len(before) : len(text) - len(after)].strip(EDGE).split()
    return " ".join(words) if 0 < len(words) <= 4 and all(NAME.fullmatch(w) for w in words) else None


def _udf(f, c: Column) -> Column:
    @pandas_udf("string")
    def run(q: pd.Series) -> pd.Series:
        return q.map(f)

    return run(c)


def plain(c: Column) -> Column:
    return _udf(plain_question, c)


def subject(c: Column) -> Column:
    """The identifier of a definition question, else null."""
    return _udf(definition_subject, c)


def variants(questions: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, kind, text: the question; its plain form if that has other terms; the name that a definition question asks
    for if its terms are none of the two."""
    q = questions.withColumns({"_plain": plain(F.col(text)), "_name": subject(F.col(text))})
    terms = lambda c: F.array_sort(F.array_distinct(T.tokens(c)))
    other = (F.col("_plain") != "") & ~terms(F.col(text)).eqNullSafe(terms(F.col("_plain")))
    named = F.col("_name").isNotNull() & ~terms(F.col("_name")).eqNullSafe(terms(F.col(text))) & ~terms(F.col("_name")).eqNullSafe(terms(F.col("_plain")))
    row = lambda n, kind, c: F.struct(F.lit(n).alias("ord"), F.lit(kind).alias("kind"), c.alias("text"))
    rows = F.array(row(0, "original", F.trim(text)), F.when(other, row(1, "normalized", F.col("_plain"))), F.when(named, row(2, "definition_subject", F.col("_name"))))
    return q.where(F.coalesce(F.trim(text), F.lit("")) != "").select(key, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("v")).select(key, "v.*")
