"""The catalog as a list of entries (documents, headings, terms): scored lookup in bands, pages, definitions, checks of terms.

Questions are a stated query set. A question meets an entry only through an equality (a shared word, the first characters of a
contained label, a shared run of Chinese characters), never by comparing all with all; scores are taken on distinct labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.containment import containing, sharing, standing
from tessera.session import cut

#: Labels that are questions rather than subjects; where the reference's bands begin (fixed values).
LOW_LABELS = "是什么 什么是 为什么 为何 怎么 怎么样 怎么做 怎么实现 如何 如何做 如何实现 怎样 哪些 有哪些 多少 什么".split()
STRONG, CLUE, LABEL_MIN, SHARED, BONUS = 500, 400, 3, 4, 30
#: What a sentence that explains a term holds (fixed values).
EXPLAINS = "是 指 表示 含义 定义为 称为 叫做 即 ： :".split()
LABEL = ["kind", "term", "aliases", "h", "title"]


def stem(path: Column) -> Column:
    """A file's name without its folder and its text suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.(?:md|markdown|mdx|txt)$", "")


def entries(blocks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """kind (document, heading, term), doc_id, heading_path, and the label they are matched by: term, aliases, h, title.
    ``terms`` has term, doc_id, heading_path and aliases."""
    b = blocks.where("source_type = 'document' AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(stem(F.col("source_file"))).alias("name"))
    docs = b.select(F.lit("document").alias("kind"), "doc_id", F.lit("").alias("heading_path"), F.col("name").alias("label"), F.array().cast("array<string>").alias("aliases"), "name")
    parsed = F.coalesce(F.from_json("heading_aliases", "array<string>"), F.array().cast("array<string>"))
    own = blocks.where("source_type = 'document' AND doc_id IS NOT NULL AND coalesce(heading_path, '') <> ''").select("doc_id", "heading_path", F.explode_outer(parsed).alias("a")).groupBy("doc_id", "heading_path").agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    heads = own.join(b, "doc_id").select(F.lit("heading").alias("kind"), "doc_id", "heading_path", F.element_at(T.heading_parts(F.col("heading_path")), -1).alias("label"), "aliases", "name")
    out = docs.unionByName(heads)
    if terms is not None:
        out = out.unionByName(terms.join(b, "doc_id", "left").select(F.lit("term").alias("kind"), "doc_id", F.coalesce("heading_path", F.lit("")).alias("heading_path"), F.col("term").alias("label"), "aliases", "name"))
    norm = F.array_sort(F.array_distinct(F.transform("aliases", lambda a: T.catalog_text(a))))
    return out.select("kind", "doc_id", "heading_path", T.catalog_text(F.col("label")).alias("term"), F.filter(norm, lambda a: a != "").alias("aliases"), T.catalog_text(F.col("heading_path")).alias("h"), T.catalog_text(F.col("name")).alias("title"))


def shared_pairs(q: Column, label: Column) -> Column:
    """How many different pairs of adjacent Chinese characters of ``q`` stand in ``label``."""
    pairs = F.array_distinct(F.regexp_extract_all(q, F.lit(f"(?=([{T.CJK}]{{2}}))"), 1))
    return F.size(F.filter(pairs, lambda g: F.contains(label, g)))


def shared_run(q: Column, label: Column, n: int = SHARED) -> Column:
    """Whether ``q`` and ``label`` have a run of ``n`` Chinese characters in common."""
    return F.exists(F.regexp_extract_all(q, F.lit(f"(?=([{T.CJK}]{{{n}}}))"), 1), lambda g: F.contains(label, g))


def score() -> Column:
    """The score of a label (LABEL, tokens) for a question (q, qtokens); the first rule that holds counts."""
    c = F.col
    doc, low = c("kind") == "document", lambda x: x.isin(LOW_LABELS)
    label = F.when(doc, c("title")).when(c("term") != "", c("term")).otherwise(c("h"))
    shared = F.size(F.array_intersect("qtokens", "tokens"))
    points = (
        F.when((c("term") != "") & (c("term") == c("q")), 1000)
        .when(F.exists("aliases", lambda a: a == c("q")), 900)
        .when((c("term") != "") & (F.length("q") >= 2) & F.contains("q", "term") & (doc | (F.length("term") >= LABEL_MIN)) & ~low(c("term")), 800)
        .when(F.exists("aliases", lambda a: (F.length(a) >= LABEL_MIN) & F.contains(c("q"), a)), 700)
        .when((c("title") != "") & (F.contains("q", "title") | F.contains("title", "q")), 500)
        .when((c("h") != "") & (F.contains("q", "h") | F.contains("h", "q")) & (doc | ((F.length("h") >= LABEL_MIN) & ~low(c("h")))), 400)
        .when(shared_run(c("q"), label) & (doc | ~low(label)), F.lit(CLUE) + F.least(shared_pairs(c("q"), label), F.lit(BONUS)))
        .when(F.exists("qtokens", lambda t: F.contains(c("h"), t)), 300)
        .when(shared > 0, F.lit(100) + F.least(shared, F.lit(99)))
        .otherwise(0)
    )
    return points + F.when((points > 0) & (c("kind") == "term"), 50).otherwise(0)


def label_tokens() -> Column:
    return T.catalog_tokens(F.concat_ws(" ", "term", F.array_join("aliases", " "), "h", "title"))


def lookup(entry: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, score, and the entry (kind, doc_id, heading_path) of every entry with a score. ``questions`` has query_id and
    question; an empty one finds nothing."""
    q = questions.select("query_id", T.catalog_text(F.col("question")).alias("q"), T.catalog_tokens(F.col("question")).alias("qtokens")).where("q <> ''")
    labels = entry.select(*LABEL).distinct().withColumn("lid", F.xxhash64(F.to_json(F.struct(*LABEL))))
    ask = q.select(F.col("query_id").alias("hid"), F.col("q").alias("text"))
    parts = F.array_distinct(F.concat(F.array("term", "h", "title"), "aliases"))
    needles = labels.select(F.col("lid").alias("nid"), F.explode(parts).alias("needle"))
    pairs = containing(needles, ask).select(F.col("nid").alias("lid"), F.col("hid").alias("query_id"))  # labels in questions
    texts = labels.select(F.col("lid").alias("hid"), F.explode(F.array_distinct(F.array("h", "title"))).alias("text"))
    words = q.select(F.col("query_id").alias("nid"), F.explode(F.array_union(F.array("q"), "qtokens")).alias("needle")).distinct()
    pairs = pairs.unionByName(containing(words, texts).select(F.col("hid").alias("lid"), F.col("nid").alias("query_id")))  # questions and their words in labels
    runs = labels.select(F.col("lid").alias("hid"), F.explode(F.array_distinct(F.array("term", "h", "title"))).alias("text"))
    pairs = pairs.unionByName(sharing(q.select(F.col("query_id").alias("nid"), F.col("q").alias("text")), runs).select(F.col("hid").alias("lid"), F.col("nid").alias("query_id")))
    tokens = labels.withColumn("tokens", label_tokens())
    same = q.select("query_id", F.explode("qtokens").alias("t")).join(tokens.select("lid", F.explode("tokens").alias("t")), "t").select("lid", "query_id")
    pairs = pairs.unionByName(same).distinct()
    scored = pairs.join(tokens, "lid").join(q, "query_id").select("query_id", "lid", score().alias("score")).where("score > 0")
    keyed = entry.withColumn("lid", F.xxhash64(F.to_json(F.struct(*LABEL))))
    return scored.join(keyed, "lid").select("query_id", "score", "kind", "doc_id", "heading_path").distinct()


def ranked(found: DataFrame) -> DataFrame:
    """``found`` with position: strong matches first, then clues that are no terms, then the rest; by score, kind, document and
    heading within."""
    band = F.when(F.col("score") >= STRONG, 0).when((F.col("kind") != "term") & (F.col("score") >= CLUE), 1).otherwise(2)
    kind = F.when(F.col("kind") == "term", 0).when(F.col("kind") == "heading", 1).otherwise(2)
    order = Window.partitionBy("query_id").orderBy(band, F.desc("score"), kind, "doc_id", "heading_path")
    return found.withColumn("position", F.row_number().over(order))


def page(positioned: DataFrame, cursor: int, limit: int) -> DataFrame:
    """A page of every query from ``cursor``, with total and next_cursor (null on the last page)."""
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    rows = positioned.withColumn("total", total).where((F.col("position") > cursor) & (F.col("position") <= cursor + limit))
    return rows.withColumn("next_cursor", F.when(F.col("total") > cursor + limit, F.lit(cursor + limit)))


def definitions(terms: DataFrame, texts: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, term and the first sentence of the document that holds the term, is longer than it and explains (a listed
    marker); terms without such a sentence have none (definition null). ``terms`` has doc_id and term, ``texts`` doc_id and text.
    Terms under ``least`` characters have none."""
    sentences = texts.select("doc_id", F.posexplode(F.split("text", r"[。！？!?；;\n]+")).alias("n", "s")).select("doc_id", "n", F.trim(F.regexp_replace("s", r"\s+", " ")).alias("s"))
    marked = F.lit(False)
    for m in EXPLAINS:
        marked |= F.contains("s", F.lit(m))
    t = terms.select("doc_id", "term", T.catalog_text(F.col("term")).alias("t")).distinct()
    hit = t.where(F.length("t") >= least).join(sentences, "doc_id").where(F.contains(T.catalog_text(F.col("s")), F.col("t")) & (F.length("s") > F.length("term")) & marked)
    best = hit.groupBy("doc_id", "term").agg(F.min(F.struct("n", "s")).alias("b")).select("doc_id", "term", F.col("b.s").alias("definition"))
    return t.select("doc_id", "term").join(best, ["doc_id", "term"], "left")


def valid_terms(candidates: DataFrame, entry: DataFrame, texts: DataFrame, most: int = 400) -> DataFrame:
    """term, doc_id, heading_path of the candidates (term, doc_id, heading_path, snippet) whose document and heading exist and
    whose snippet stands in the document; one of equal terms (by catalog form), the first by (term, doc_id, heading_path); at
    most ``most``, the catalog's size (a limit that is the feature)."""
    known = entry.select("doc_id", "heading_path").distinct()
    c = candidates.where("length(trim(term)) > 0").join(known, ["doc_id", "heading_path"], "left_semi").join(texts.groupBy("doc_id").agg(F.min("text").alias("text")), "doc_id")
    c = c.where(F.coalesce(F.contains("text", "snippet"), F.lit(False))).groupBy(T.catalog_text(F.col("term")).alias("key")).agg(F.min(F.struct("term", "doc_id", "heading_path")).alias("r"))
    return c.select("r.*").orderBy("term", "doc_id", "heading_path").limit(most)


def resolve_scope(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """query_id and doc_id of the one document a question names: whose title it holds, else the one with a quoted fragment of the
    question in its title, else the one that shares most pairs of characters (at least four, and more than any other).
    ``titles`` has doc_id and title. Questions that name none or several have no row."""
    spark = questions.sparkSession
    q = cut(spark, questions.select("query_id", T.catalog_text(F.col("question")).alias("q")).where("q <> ''"), "questions")
    t = cut(spark, titles.select("doc_id", T.catalog_text(F.col("title")).alias("title")).where("length(title) >= 2").distinct(), "titles")
    # titles and questions meet once each by their text; of the documents, whether they are one is all that counts
    ends = lambda low, high: (F.min(low).alias("low"), F.max(high).alias("high"))
    own = t.groupBy("title").agg(*ends("doc_id", "doc_id"))
    rest = lambda left, known: left.join(known.select(F.col("query_id").alias("known")), F.col("query_id").eqNullSafe(F.col("known")), "left_anti")
    holds = standing(t.select(F.col("title").alias("needle")), q.select(F.col("q").alias("text")))
    holds = holds.join(own, F.col("needle") == F.col("title")).groupBy("text").agg(*ends("low", "high"))
    whole = cut(spark, q.join(holds, F.col("q") == F.col("text")).groupBy("query_id").agg(*ends("low", "high")), "whole")
    q = cut(spark, rest(q, whole), "questions")
    quoted = q.select("query_id", F.explode(F.regexp_extract_all("q", F.lit("[「『《“\"]([^」』》”\"\\n]{2,60})[」』》”\"]"), 1)).alias("needle")).distinct()
    stands = standing(quoted, t.select(F.col("title").alias("text"))).join(own, F.col("text") == F.col("title")).groupBy("needle").agg(*ends("low", "high"))
    part = cut(spark, quoted.join(stands, "needle").groupBy("query_id").agg(*ends("low", "high")), "part")
    q = rest(q, part)
    pairs = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?=([{T.CJK}]{{2}}))"), 1))
    overlap = q.select("query_id", F.explode(pairs(F.col("q"))).alias("g")).join(t.select("doc_id", F.explode(pairs(F.col("title"))).alias("g")), "g").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    most = overlap.groupBy("query_id", "n").agg(*ends("doc_id", "doc_id")).groupBy("query_id").agg(F.max_by(F.struct("low", "high"), "n").alias("e")).select("query_id", "e.*")
    return whole.unionByName(part).unionByName(most).where("low = high").select("query_id", F.col("low").alias("doc_id"))


def tool_catalog(blocks: DataFrame, positions: int = 10) -> DataFrame:
    """doc_id, headings (distinct), the first ``positions`` block ids in reading order, and the file of the first block."""
    b = blocks.where("doc_id IS NOT NULL AND block_id IS NOT NULL").groupBy("doc_id", "block_id").agg(F.min("document_order").alias("o"), F.min("heading_path").alias("h"), F.min("source_file").alias("f"))
    first = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("o"), "block_id")
    heads = b.groupBy("doc_id").agg(F.countDistinct(F.nullif("h", F.lit(""))).alias("headings"))
    few = b.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positions)
    listed = few.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block_id"))), lambda x: x["block_id"]), ",").alias("positions"), F.min_by("f", "n").alias("source_file"))
    return heads.join(listed, "doc_id")


def relabelled(found: DataFrame) -> DataFrame:
    """``found`` (with position) and a short label D1, D2, … of its document by first appearance in the query."""
    first = found.groupBy("query_id", "doc_id").agg(F.min("position").alias("first"))
    named = first.withColumn("label", F.concat(F.lit("D"), F.row_number().over(Window.partitionBy("query_id").orderBy("first")).cast("string")))
    return found.join(named.drop("first"), ["query_id", "doc_id"])
