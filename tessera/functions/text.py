"""Text functions as column expressions (whole-stage code), each with the SQL that DuckDB runs for the same result."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with a compatibility form of one character, and that form: built from the Unicode tables, not listed.
_ONE = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, 0x20000) if not 0xD800 <= c <= 0xDFFF]
_ONE = [(a, b) for a, b in _ONE if len(b) == 1 and a != b and len(unicodedata.normalize("NFD", a)) == 1]
FOLD_FROM, FOLD_TO = "".join(a for a, _ in _ONE), "".join(b for _, b in _ONE)
#: Ligatures and signs with longer forms that occur in prose (fixed values).
FOLD_LONG = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "...", "℃": "°C", "№": "No"}

CJK = "一-鿿"
#: Terms that name the form of a question or a broad relation; they score but cannot alone justify a hit (fixed values).
LOW_INFORMATION = (
    "中的 的应 的作 的对 的方 的内 的是 何实 如何 怎么 怎样 什么 是什 发生 生了 了什 之前 前的 在知 知识 识库 库中 哪些 是否 需要 通过 进行 使用 可以 分别 相关 内容 详情 介绍 说明 实现 系统 应用 作用 机制 控制 计算 分析 平均"
).split()
#: ASCII words that are no identifiers (fixed values).
STOP_WORDS = "and are for from how in into is of the to what".split()

PERCENTILE = r"(?i)(?<![A-Za-z0-9.])(?:p(\d{1,2}(?:\.\d+)?)(?![\d.])|(\d{1,2}(?:\.\d+)?)\s*%?\s*(?:百分位|分位)数?)"
PUNCTUATED = "；：，。、()（）$.,/\\[\\]{}:;|"


def quoted(text: str) -> str:
    """``text`` as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def compatibility_folded(c: Column) -> Column:
    """NFKC for characters of one-character or listed forms (composition of separate accents is not included)."""
    for a, b in FOLD_LONG.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, FOLD_FROM, FOLD_TO)


def compatibility_folded_sql(c: str) -> str:
    for a, b in FOLD_LONG.items():
        c = f"replace({c}, {quoted(a)}, {quoted(b)})"
    return f"translate({c}, {quoted(FOLD_FROM)}, {quoted(FOLD_TO)})"


#: Characters whose folding can change a token; others (Chinese punctuation, accented letters) need no folding for it.
FOLDS = "[\\x{A0}-\\x{BF}\\x{132}-\\x{17F}\\x{1C4}-\\x{1FF}\\x{2B0}-\\x{2E4}\\x{1D00}-\\x{1EFF}\\x{2000}-\\x{2FDF}\\x{3100}-\\x{33FF}\\x{F900}-\\x{FAFF}\\x{FB00}-\\x{FE6F}\\x{FF05}\\x{FF0D}\\x{FF0E}\\x{FF10}-\\x{FF19}\\x{FF20}-\\x{FF5A}\\x{FF66}-\\x{FFEF}\\x{1D400}-\\x{1FBFF}]"


def canonical_percentiles(c: Column) -> Column:
    """P99, 99% 分位 and 九九分位 become `` p99 ``; superfluous zeros go."""
    c = F.when(c.rlike(FOLDS), compatibility_folded(c)).otherwise(c)
    n = F.regexp_replace(c, "(?:九十九|九九)(?=\\s*%?\\s*(?:百分位|分位))", "99")
    n = F.regexp_replace(n, PERCENTILE, " p$1$2 ")
    n = F.regexp_replace(n, r"(?<= p)0+(?=\d)", "")
    n = F.regexp_replace(F.regexp_replace(n, r"(?<= p\d{1,2}\.\d{0,6}?)0+(?= )", ""), r"(?<= p\d{1,2})\.(?= )", "")
    return F.when(c.rlike(r"分位|[pP]\d"), n).otherwise(c)


def tokens(c: Column) -> Column:
    """ASCII words in lower case, then adjacent pairs of Chinese characters of each run; single characters give none."""
    text = canonical_percentiles(F.coalesce(c, F.lit("")))
    ascii_words = F.transform(F.regexp_extract_all(text, F.lit("([0-9a-zA-Z_@.\\-]+)"), 1), F.lower)
    pairs = F.regexp_extract_all(text, F.lit(f"(?=([{CJK}]{{2}}))"), 1)
    return F.concat(ascii_words, pairs)


def tokens_sql(c: str) -> str:
    """The same; DuckDB has no lookahead, so the pairs of a run are taken by position."""
    text = compatibility_folded_sql(f"coalesce({c}, '')")
    return (
        f"list_concat(list_transform(regexp_extract_all({text}, '[0-9a-zA-Z_@.\\-]+'), lambda x: lower(x)), "
        f"flatten(list_transform(regexp_extract_all({text}, '[{CJK}]+'), lambda r: list_transform(generate_series(1, length(r) - 1), lambda i: substring(r, i::BIGINT, 2)))))"
    )


def is_identifier(c: Column) -> Column:
    """An ASCII token of two characters or more with a letter that is no stop word."""
    return c.rlike("^[0-9a-zA-Z_@.\\-]{2,}$") & c.rlike("[a-zA-Z]") & ~c.isin(STOP_WORDS)


def is_identifier_sql(c: str) -> str:
    words = ", ".join(quoted(w) for w in STOP_WORDS)
    return f"(regexp_full_match({c}, '[0-9a-zA-Z_@.\\-]{{2,}}') AND regexp_matches({c}, '[a-zA-Z]') AND {c} NOT IN ({words}))"


def is_low_information(c: Column) -> Column:
    return c.isin(LOW_INFORMATION)


def low_information_sql(c: str) -> str:
    return f"{c} IN ({', '.join(quoted(w) for w in LOW_INFORMATION)})"


def numeric_noise(c: Column, ratio: float = 0.45, least: int = 50) -> Column:
    """Whether digits and punctuation make up more than ``ratio`` of a text of ``least`` characters or more."""
    rest = F.regexp_replace(c, f"[0-9{PUNCTUATED}]", "")
    return F.coalesce((F.length(c) >= least) & ((F.length(c) - F.length(rest)) / F.length(c) > ratio), F.lit(False))


def numeric_noise_sql(c: str) -> str:
    return f"coalesce(length({c}) >= 50 AND (length({c}) - length(regexp_replace({c}, '[0-9{PUNCTUATED}]', '', 'g'))) / length({c}) > 0.45, false)"


def line_noise(c: Column) -> Column:
    """Lines that hold no knowledge: tags only, an address only (Chinese text ends one), no letters and digits."""
    t = F.trim(c)
    return t.rlike(r"(?U)^(?:#[\w/-]+\s*)+$") | t.rlike(rf"(?U)^(?:https?://[^\s{CJK}，。！？；：、]+[.。]?\s*)+$") | t.rlike(r"^[^\p{L}\p{N}]*$")


def catalog_text(c: Column) -> Column:
    """For matching: compatibility forms folded, lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(compatibility_folded(F.coalesce(c, F.lit("")))), r"\s+", " "))


def catalog_text_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({compatibility_folded_sql(f'coalesce({c}, {chr(39)}{chr(39)})')}), '\\s+', ' ', 'g'))"


def catalog_tokens(c: Column) -> Column:
    """Distinct ASCII words and Chinese runs of two and three characters (a single one where it stands alone)."""
    text = catalog_text(c)
    two = F.regexp_extract_all(text, F.lit(f"(?=([{CJK}]{{2}}))"), 1)
    three = F.regexp_extract_all(text, F.lit(f"(?=([{CJK}]{{3}}))"), 1)
    one = F.regexp_extract_all(text, F.lit(f"(?<![{CJK}])([{CJK}])(?![{CJK}])"), 1)
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit("([a-z0-9][a-z0-9_.\\-]*)"), 1), two, three, one))


def canonical_query(c: Column) -> Column:
    """A query without punctuation and white space, in lower case: equal queries get equal keys."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s，,。.？?！!、；;：:\"'“”‘’（）()《》<>\[\]【】]+", ""))


def web_url(c: Column) -> Column:
    """One form of an address: scheme and host in lower case, no fragment, no tracking or display parameters, no closing slash."""
    c = F.trim(c)
    scheme, host, port = F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(c, F.lit("HOST"))), F.regexp_extract(c, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?[^/?#:]*:(\d+)", 1)
    path = F.regexp_replace(F.coalesce(F.nullif(F.try_parse_url(c, F.lit("PATH")), F.lit("")), F.lit("/")), "/{2,}", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    kept = F.filter(F.split(F.coalesce(F.try_parse_url(c, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike("^(utm_.*|ref|source|campaign|highlight)$"))
    kept = F.transform(kept, lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(scheme.isNull() | host.isNull(), c).otherwise(F.concat(scheme, F.lit("://"), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), path, query))


def heading_parts(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), " > ")


def heading_parent(c: Column) -> Column:
    """The path without its last part; empty for a single part."""
    return F.when(F.instr(c, " > ") > 0, F.regexp_replace(c, "(?s) > (?:(?! > ).)*$", "")).otherwise("")


def snippet(text: Column, terms: list[str], width: int = 80) -> Column:
    """A window around the earliest term, with ellipses where it is cut."""
    low = F.lower(text)
    at = F.least(*[F.when(F.locate(t, low) > 0, F.locate(t, low)) for t in terms], F.lit(1 << 30))
    at = F.when(at == 1 << 30, 1).otherwise(at)
    start = F.greatest(at - width // 2, F.lit(1))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substr(text, start, F.lit(width)), F.when(start + width - 1 < F.length(text), "…").otherwise(""))


def embedding_text(source_file: Column, heading: Column, text: Column) -> Column:
    """What a chunk is embedded as: file stem, heading path and text, those that exist."""
    stem = F.regexp_replace(F.regexp_extract(source_file, "([^/]*)$", 1), "\\.[^.]*$", "")
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.concat_ws("\n", part("文档：", stem), part("标题：", heading), part("内容：", text))


def redacted(c: Column, names: dict[str, str]) -> Column:
    """Each name replaced by its alias, longer names first."""
    for name in sorted(names, key=lambda n: (-len(n), n)):
        c = F.replace(c, F.lit(name), F.lit(names[name]))
    return c


