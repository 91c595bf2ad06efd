"""Further scalar functions as column expressions: dates, JSON, evidence, pictures, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Words after which a question names what it asks about, and words that are no focus (fixed values).
FOCUS = "(?:是否有|有没有|有无|是否|能否|可否|会不会|有|能|会|可以)([^？?。！!，,、；;\\s]{2,12})"
FOCUS_STOP = "什么 哪些 哪个 怎么 如何 多少 多久 吗 呢 的 了".split()
#: ASCII words that identify nothing (fixed values).
PLAIN_ASCII = "the and for with from".split()
#: What says that something is missing (fixed values).
GAP_MARKERS = "未找到 没有找到 未提及 没有提及 未说明 没有说明 资料不足 依据不足 无法确认 无法确定 缺少 缺乏 暂无 not found no evidence insufficient".split()


# ---- dates


def day_in_range(ts: Column, start: str | None, end: str | None) -> Column:
    """Whether the first ten characters of an ISO text are a day from ``start`` to ``end``, both included; null is in none."""
    day = F.substring(ts, 1, 10)
    rule = F.lit(True)
    if start:
        rule &= day >= start
    if end:
        rule &= day <= end
    return F.coalesce(rule & day.isNotNull(), F.lit(False))


def within_days(ts: Column, start: str | None, end: str | None) -> Column:
    """A range on a timestamp whose last day is included; bounds may be days or whole timestamps."""
    rule = F.lit(True)
    if start and start.strip():
        rule &= ts >= F.lit(start.strip()).cast("timestamp")
    if end and end.strip():
        end = end.strip()
        rule &= (ts < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")) if len(end) == 10 else (ts <= F.lit(end).cast("timestamp"))
    return F.coalesce(rule, F.lit(False))


def local_day(ts: Column, zone: str) -> Column:
    """The day of a UTC timestamp in a time zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def resolved_range(word: Column, now: Column, zone: str) -> Column:
    """start and end (days) of today, yesterday, this week, last seven days and this month, as seen in ``zone``; null for others."""
    today = local_day(now, zone)
    monday = F.date_sub(today, F.weekday(today))
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return (
        F.when(word.isin("today", "今天"), pair(today, today)).when(word.isin("yesterday", "昨天"), pair(F.date_sub(today, 1), F.date_sub(today, 1)))
        .when(word.isin("this week", "本周"), pair(monday, today)).when(word.isin("last 7 days", "最近七天"), pair(F.date_sub(today, 6), today))
        .when(word.isin("this month", "本月"), pair(F.trunc(today, "month"), today))
    )


def iso_seconds(ts: Column) -> Column:
    """A timestamp as ISO text of seconds, UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# ---- JSON and maps


def json_in(text: Column) -> Column:
    """The JSON object or array in a model's answer: of the first fenced block, else from the first bracket to the last that
    closes it; null if that does not parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    first = F.regexp_extract(body, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when((first != "") & F.try_parse_json(first).isNotNull(), first)


def canonical_json(*columns: Column | str) -> Column:
    """Columns as JSON with names in order; nulls are left out."""
    names = sorted(columns, key=str)
    return F.to_json(F.struct(*names))


def args_hash(*columns: Column | str) -> Column:
    """A hash that equal arguments share."""
    return F.sha2(canonical_json(*columns), 256)


def without_nulls(m: Column) -> Column:
    """A map without the keys whose value is null."""
    return F.map_filter(m, lambda _, v: v.isNotNull())


# ---- evidence


def support_tokens(c: Column) -> Column:
    """The informative tokens of a text, each once."""
    return F.filter(F.array_distinct(T.tokens(c)), lambda t: ~T.is_low_information(t))


def focus_tokens(c: Column) -> Column:
    """The tokens of what a yes-no question asks about; none if it is no such question."""
    focus = F.regexp_replace(F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""), FOCUS, 1), "^[的了把将]+", "")
    focus = F.regexp_replace(focus, "[" + "".join(w for w in FOCUS_STOP if len(w) == 1) + "]", "")
    return F.when(F.length(focus) >= 2, F.filter(support_tokens(focus), lambda t: ~t.isin(FOCUS_STOP))).otherwise(F.array().cast("array<string>"))


def supports(question: Column, text: Column) -> Column:
    """Whether a text supports a question: it holds a fifth of its informative tokens or three of them, and one of its focus."""
    low, tokens, focus = F.lower(text), support_tokens(question), focus_tokens(question)
    hits = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
    enough = (hits > 0) & ((hits >= 3) | (hits >= 0.2 * F.size(tokens)))
    return F.coalesce(enough & ((F.size(focus) == 0) | F.exists(focus, lambda t: F.contains(low, t))), F.lit(False))


def lexically_relevant(question: Column, text: Column, similarity: Column, least: float = 0.45) -> Column:
    """A dense score decides where there is one; else at least two of the informative tokens (or the only one)."""
    tokens = support_tokens(question)
    hits = F.size(F.filter(tokens, lambda t: F.contains(F.lower(text), t)))
    return F.coalesce(similarity >= least, (F.size(tokens) > 0) & (hits >= F.least(F.lit(2), F.size(tokens))), F.lit(False))


def gap_disclosed(paragraph: Column, missing: Column) -> Column:
    """Whether a paragraph says openly that ``missing`` is missing: a marker of it, and the subject itself, half of its ASCII
    words, or two and a quarter of its pairs of Chinese characters."""
    low = F.lower(paragraph)
    marked = F.lit(False)
    for m in GAP_MARKERS:
        marked |= F.contains(low, F.lit(m))
    compact = lambda c: F.regexp_replace(F.lower(c), f"[^0-9A-Za-z{T.CJK}]+", "")
    words = lambda c: F.filter(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z0-9_.+/#-]+)"), 1), F.lower)), lambda w: ~w.isin(PLAIN_ASCII))
    pairs = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?=([{T.CJK}]{{2}}))"), 1))
    shared = lambda f: F.size(F.array_intersect(f(missing), f(paragraph)))
    whole = (compact(missing) != "") & F.contains(compact(paragraph), compact(missing))
    ascii_ = (F.size(words(missing)) > 0) & (shared(words) >= 0.5 * F.size(words(missing)))
    han = (F.size(pairs(missing)) > 0) & (shared(pairs) >= 2) & (shared(pairs) >= 0.25 * F.size(pairs(missing)))
    return F.coalesce(marked & (whole | ascii_ | han), F.lit(False))


def numbers_equal(a: Column, b: Column) -> Column:
    """Whether two stated numbers may be the same: equal, equal when rounded to the fewer places, a hundred times the other
    (per cent), or, where both have places, within one per cent."""
    x, y = a.try_cast("double"), b.try_cast("double")
    places = lambda c: F.length(F.regexp_extract(c, r"\.(\d+)$", 1))
    fewer = F.pow(F.lit(10.0), F.least(places(a), places(b)))
    rounded = F.round(x * fewer) == F.round(y * fewer)
    close = (places(a) > 0) & (places(b) > 0) & (F.abs(x - y) <= 0.01 * F.greatest(F.abs(x), F.abs(y)))
    return F.coalesce((x == y) | rounded | (F.abs(x * 100 - y) < 1e-9) | (F.abs(x - y * 100) < 1e-9) | close, F.lit(False))


# ---- text windows


def compact_context(c: Column, most: int = 400) -> Column:
    """A text's paragraphs, each once in lower case, up to ``most`` characters."""
    parts = F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    lows = F.transform(parts, F.lower)
    first = F.filter(parts, lambda p, i: F.array_position(lows, F.lower(p)) == i + 1)
    return F.substring(F.array_join(first, "\n"), 1, most)


def image_facts(c: Column, dropped: tuple[str, ...] = ("context", "上下文", "背景")) -> Column:
    """The sections of a picture's description that were observed: headed parts, without those of context, without empty ones,
    each once; the whole text if it has no headings."""
    bare = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?m)^(?=#{1,6}\s)"), lambda p: bare(p) != "")
    head = lambda p: F.lower(F.trim(F.regexp_extract(p, r"^#{1,6}\s+([^\n]*)", 1)))
    body = lambda p: bare(F.regexp_replace(p, r"^#{1,6}\s+[^\n]*\n?", ""))
    kept = F.filter(parts, lambda p: ~head(p).isin([d.lower() for d in dropped]) & (body(p) != ""))
    return F.array_join(F.array_distinct(F.transform(kept, bare)), "\n\n")


def image_summary(c: Column, most: int = 600) -> Column:
    """What a picture is indexed by: its facts on one line, cut at ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(image_facts(c), r"\s+", " ")), 1, most)


def informative_heading(heading: Column) -> Column:
    """The last part of a heading path if it is content itself: an address, or a label with its value."""
    leaf = F.element_at(T.heading_parts(heading), -1)
    return F.when(leaf.rlike(r"https?://\S+") | leaf.rlike(r"^[^:：]{1,40}[:：]\s*\S+"), leaf)


def document_title(text: Column) -> Column:
    """The title of the front matter, else the first heading of the first level that is not empty, else null."""
    head = F.regexp_extract(text, r"\A﻿?---[ \t]*\n((?s).*?)\n---", 1)
    named = F.trim(F.regexp_replace(F.regexp_extract(head, r"(?m)^title:[ \t]*(.*)$", 1), "^[\"']|[\"']$", ""))
    first = F.trim(F.regexp_extract(text, r"(?m)^# +([^\n]*[^\s#])[ \t]*#*[ \t]*$", 1))
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(first, F.lit("")))


def front_matter(text: Column) -> Column:
    """The keys and values of the front matter; an empty map without one."""
    head = F.regexp_extract(text, r"\A﻿?---[ \t]*\r?\n((?s).*?)\r?\n---", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[^\s:#-][^:]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1))


def embedding_query(question: Column, model: str) -> Column:
    """A question as the model wants it: one family takes an instruction before it."""
    instruction = "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery:"
    return F.concat(F.lit(instruction), question) if "qwen3-embedding" in model.lower() else question


def focused_offset(text: Column, terms: Column, width: int) -> Column:
    """The start (from 0) of the window of ``width`` characters with the most different terms, the first of equal ones; windows
    begin at every quarter of the width. Without a hit 0."""
    low = F.lower(text)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(max(1, width // 4)))
    hits = lambda s: F.size(F.filter(terms, lambda t: F.instr(F.substr(low, s + 1, F.lit(width)), t) > 0))
    best = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("s")), lambda a, s: F.when(hits(s) > a["n"], F.struct(hits(s).alias("n"), s.cast("int").alias("s"))).otherwise(a))
    return best["s"]
