"""Evidence of a research run: what supports which requirement, coverage, gaps, budgets, targets to read, queries to merge.

Evidence is evidence_id, source_type, source_ref, content, title, heading. Requirements (requirement_id, text) are a stated set
per run; the two meet through shared tokens (an equality), and the rule is checked on those pairs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import text as T
from tessera.operators import evidence as E
from tessera.operators.containment import containing


def attributed(evidence: DataFrame, requirements: DataFrame, named: list[str] | None = None) -> DataFrame:
    """evidence_id and requirement_id of what supports what: the text supports the requirement, or a term that the user named
    stands in both. Of knowledge, evidence without any of the named terms that are exact names supports nothing."""
    ev = evidence.select("evidence_id", "source_type", "content", F.lower(F.concat_ws(" ", "title", "heading", "content")).alias("whole"))
    wanted = [t.strip().lower() for t in named or [] if len(t.strip()) >= 2]
    exact = [t for t in wanted if any(a.isascii() and a.isalnum() and b in "._/-" and c.isascii() and c.isalnum() for a, b, c in zip(t, t[1:], t[2:], strict=False))]
    if exact:
        there = F.lit(False)
        for t in exact:
            there |= F.contains("whole", F.lit(t))
        ev = ev.where((F.col("source_type") != "knowledge") | there)
    r = requirements.select("requirement_id", "text", F.explode(S.support_tokens(F.col("text"))).alias("needle"))
    pairs = containing(r.select(F.struct("requirement_id").alias("nid"), "needle"), ev.select(F.struct("evidence_id").alias("hid"), F.lower("content").alias("text")))
    pairs = pairs.select("nid.requirement_id", "hid.evidence_id").distinct()
    met = pairs.join(requirements.select("requirement_id", "text"), "requirement_id").join(ev.select("evidence_id", "content"), "evidence_id").where(S.supports(F.col("text"), F.col("content"))).select("evidence_id", "requirement_id")
    for t in wanted:
        own = requirements.where(F.contains(F.lower("text"), F.lit(t))).select("requirement_id", F.lit(t).alias("t"))
        met = met.unionByName(ev.where(F.contains("whole", F.lit(t))).select("evidence_id", F.lit(t).alias("t")).join(own, "t").select("evidence_id", "requirement_id"))
    return met.distinct()


def coverage(requirements: DataFrame, supported: DataFrame, evidence: DataFrame) -> DataFrame:
    """requirement_id, evidence (how many support it) and state: answered if one of them is readable (has content), partial if
    some support it but none can be read, else missing."""
    j = supported.join(evidence.select("evidence_id", (F.coalesce(F.trim("content"), F.lit("")) != "").alias("readable")), "evidence_id")
    g = j.groupBy("requirement_id").agg(F.countDistinct("evidence_id").alias("evidence"), F.bool_or("readable").alias("readable"))
    state = F.when(F.coalesce("readable", F.lit(False)), "answered").when(F.coalesce("evidence", F.lit(0)) > 0, "partial").otherwise("missing")
    return requirements.select("requirement_id").distinct().join(g, "requirement_id", "left").select("requirement_id", F.coalesce("evidence", F.lit(0)).alias("evidence"), state.alias("state"))


def complete(covered: DataFrame, run: str) -> DataFrame:
    """Per run whether every requirement is answered, how many are not, and whether none is missing."""
    return covered.groupBy(run).agg(F.bool_and(F.col("state") == "answered").alias("complete"), F.count_if(F.col("state") != "answered").alias("open"), F.bool_and(F.col("state") != "missing").alias("supported"))


def merged(evidence: DataFrame, more: DataFrame, requirements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Supplementary evidence joined in: the evidence without copies and contained texts, its attribution and the coverage."""
    every = deduplicated(evidence.unionByName(more))
    supported = attributed(every, requirements)
    return every, supported, coverage(requirements, supported, every)


def deduplicated(evidence: DataFrame) -> DataFrame:
    """Evidence once: of equal source and content the smallest id; of one document's texts those that stand in a longer one of it
    go. Texts of a document meet through their first characters."""
    first = evidence.groupBy("source_type", "source_ref", "content").agg(F.min("evidence_id").alias("evidence_id"))
    one = evidence.join(first.select("evidence_id").distinct(), "evidence_id", "left_semi").dropDuplicates(["evidence_id"])
    c = one.where("length(content) > 0").select("evidence_id", F.concat_ws("\x1f", "source_type", "source_ref").alias("doc"), "content")
    pairs = containing(c.select(F.col("evidence_id").alias("nid"), "doc", F.col("content").alias("needle")), c.select(F.struct(F.col("evidence_id").alias("i"), F.length("content").alias("n")).alias("hid"), "doc", F.col("content").alias("text")), "doc")
    inside = pairs.join(c.select(F.col("evidence_id").alias("nid"), F.length("content").alias("n")), "nid").where(F.col("hid.n") > F.col("n")).select(F.col("nid").alias("evidence_id")).distinct()
    return one.join(inside, "evidence_id", "left_anti")


def disclosed(paragraphs: DataFrame, missing: DataFrame) -> DataFrame:
    """answer_id, requirement_id and disclosed: whether one of an answer's paragraphs (answer_id, paragraph) says openly that a
    missing requirement (answer_id, requirement_id, text) is missing."""
    j = missing.join(paragraphs, "answer_id", "left")
    return j.groupBy("answer_id", "requirement_id").agg(F.coalesce(F.bool_or(S.gap_disclosed(F.col("paragraph"), F.col("text"))), F.lit(False)).alias("disclosed"))


def quoted_terms(answers: DataFrame, lines: DataFrame, headings: DataFrame) -> DataFrame:
    """answer_id and term of what answers (answer_id, answer) put in quotation marks though it stands in none of the lines they
    cite (answer_id, line) and in no heading of their sources (answer_id, heading)."""
    marks = "「([^「」\\n]{2,120})」|『([^『』\\n]{2,120})』|“([^“”\\n]{2,120})”|\"([^\"\\n]{2,120})\""
    raw = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(marks), 0))).alias("q")).select("answer_id", F.expr("substring(q, 2, length(q) - 2)").alias("term")).distinct()
    cited = lines.select("answer_id", F.col("line").alias("t")).unionByName(headings.select("answer_id", F.col("heading").alias("t")))
    there = raw.join(cited, "answer_id").where(F.contains("t", "term")).select("answer_id", "term").distinct()
    return raw.join(there, ["answer_id", "term"], "left_anti")


def unsupported_claims(answers: DataFrame, lines: DataFrame) -> DataFrame:
    """answer_id, value, unit of the numbers with a unit in answers that no cited line states with that unit (within the
    tolerance of ``numbers_equal``)."""
    claims = lambda df, c: df.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(E.CLAIM), 0))).alias("s")).select("answer_id", F.regexp_extract("s", E.CLAIM, 1).alias("value"), F.lower(F.regexp_extract("s", E.CLAIM, 2)).alias("unit")).distinct()
    a, b = claims(answers, "answer"), claims(lines, "line").withColumnRenamed("value", "stated")
    met = a.join(b, ["answer_id", "unit"]).where(S.numbers_equal(F.col("value"), F.col("stated"))).select("answer_id", "value", "unit").distinct()
    return a.join(met, ["answer_id", "value", "unit"], "left_anti").select("answer_id", "value", "unit")


def url_families(hits: DataFrame, most: int) -> DataFrame:
    """The first ``most`` different addresses of every query (query_id, url, ord), each by its first hit (a limit that is the
    feature)."""
    f = hits.groupBy("query_id", T.web_url(F.col("url")).alias("family")).agg(F.min(F.struct("ord", "url")).alias("f"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("f.ord", "family"))).where(F.col("place") <= most).select("query_id", "family", "f.url", "place")


def ranked_hits(hits: DataFrame, preferred: list[str] | None = None) -> DataFrame:
    """Web hits (query_id, question, url, title, snippet, score, ord) in the order they are read: preferred hosts, then how many of
    the question's tokens title and snippet hold, then score, then arrival."""
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    hits = hits.withColumns({"preferred": F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))).isin(preferred or [""]), F.lit(False)), "overlap": F.size(F.filter(S.support_tokens(F.col("question")), lambda t: F.contains(text, t)))})
    order = Window.partitionBy("query_id").orderBy(F.desc("preferred"), F.desc("overlap"), F.desc_nulls_last("score"), "ord", "url")
    return hits.withColumn("place", F.row_number().over(order))


def web_matches(question: Column, title: Column, content: Column) -> Column:
    """Whether a page is about what a question names: every parameter-like name, every number with a bound, else (without
    such) the rule of support."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(r"([A-Za-z][A-Za-z0-9]*(?:[_.-][A-Za-z0-9]+)+)"), 1), F.lower))
    bounds = F.array_distinct(F.regexp_extract_all(question, F.lit(r"(?:[<>≤≥]=?|至少|至多|不超过|不少于|at least|at most)\s*(\d+(?:\.\d+)?)"), 1))
    whole = F.lower(F.concat_ws(" ", title, content))
    exact = F.forall(names, lambda n: F.contains(whole, n)) & F.forall(bounds, lambda b: F.contains(whole, b))
    return F.when((F.size(names) > 0) | (F.size(bounds) > 0), exact).otherwise(S.supports(question, F.concat_ws(" ", title, content)))


def read_targets(headings: DataFrame, most: int = 2) -> DataFrame:
    """Per question the ``most`` headings to read next (query_id, question, doc_id, heading, similarity): ten points for each shared
    token, plus the similarity; those without a shared token are none."""
    shared = F.size(F.array_intersect(S.support_tokens(F.col("question")), T.tokens(F.col("heading"))))
    h = headings.withColumn("points", F.when(shared > 0, shared * 10 + F.coalesce("similarity", F.lit(0.0)))).where("points IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy(F.desc("points"), "doc_id", "heading")
    return h.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "doc_id", "heading", F.round("points", 6).alias("points"), "place")


def reused(asked: DataFrame, windows: DataFrame) -> DataFrame:
    """``asked`` reads (read_id, doc_id, start, stop) and the stored window (window_id) that covers each whole, the smallest such,
    else null: those with one are not read again."""
    w = windows.select("window_id", F.col("doc_id").alias("_doc"), F.col("start").alias("_a"), F.col("stop").alias("_b"))
    j = asked.join(w, (F.col("doc_id") == F.col("_doc")) & (F.col("_a") <= F.col("start")) & (F.col("stop") <= F.col("_b")), "left")
    return j.groupBy("read_id", "doc_id", "start", "stop").agg(F.min_by("window_id", F.struct(F.col("_b") - F.col("_a"), F.col("window_id"))).alias("window_id"))


def query_identity(c: Column) -> Column:
    """What a question is about, whatever its wording: its objects (names, numbers) and its pairs of informative characters, in
    order. Equal identities are one question."""
    names = F.array_sort(F.array_distinct(F.filter(T.tokens(c), T.is_identifier)))
    numbers = F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)"), 1)))
    rest = F.array_sort(F.filter(F.array_distinct(T.tokens(c)), lambda t: ~T.is_low_information(t) & t.rlike(f"^[{T.CJK}]")))
    return F.sha2(F.to_json(F.struct(names.alias("a"), numbers.alias("b"), rest.alias("c"))), 256)


def merged_queries(queries: DataFrame) -> DataFrame:
    """query_id, question and merged (how many) of a set of queries (query_id, ord, question): those of one canonical form, and
    then of one identity, are one, the first stays."""
    one = queries.where("trim(question) <> ''").groupBy(T.canonical_query(F.col("question")).alias("k")).agg(F.min(F.struct("ord", "query_id", "question")).alias("f"), F.count(F.lit(1)).alias("n")).select("f.*", "n")
    return one.groupBy(query_identity(F.col("question")).alias("k")).agg(F.min(F.struct("ord", "query_id", "question")).alias("f"), F.sum("n").alias("merged")).select("f.query_id", "f.question", "merged")


def page_window(pages: DataFrame, offset: int, limit: int) -> DataFrame:
    """A window of each page (page_id, text): its part, total characters, whether it is complete and where the next begins, and the
    headings that enclose its start (the last of every level before it)."""
    n = F.length("text")
    part = F.substring("text", offset + 1, limit)
    before = F.substring("text", 1, offset)
    heads = lambda k: F.regexp_extract_all(F.concat(F.lit("\n"), before, F.lit("\n")), F.lit(rf"\n#{{{k}}} +([^\n]*\S)"), 1)
    last = lambda k: F.when(F.size(heads(k)) > 0, F.element_at(heads(k), -1))
    at = lambda k: F.when(F.size(heads(k)) > 0, F.length(F.call_function("substring_index", F.concat(F.lit("\n"), before), F.concat(F.lit("\n" + "#" * k + " "), last(k)), F.lit(-1))))  # noqa: E731 - characters after it
    kept = [F.when(last(k).isNotNull() & F.coalesce(*[F.when(at(j) < at(k), F.lit(False)) for j in range(1, k)], F.lit(True)), last(k)) for k in range(1, 4)]
    return pages.select("page_id", part.alias("part"), n.alias("characters"), (n <= offset + limit).alias("complete"), F.when(n > offset + limit, F.lit(offset + limit)).alias("next"), F.array_join(F.filter(F.array(*kept), lambda h: h.isNotNull()), " > ").alias("heading_path"))
