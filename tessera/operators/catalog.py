"""Catalog of documents, reading windows, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.containment import containing

HEADINGS = 64


def outline(blocks: DataFrame) -> DataFrame:
    """doc_id, blocks, headings, outline (the first HEADINGS distinct paths in reading order, joined by |)."""
    b = blocks.where("doc_id IS NOT NULL")
    h = b.where("coalesce(heading_path, '') <> ''").groupBy("doc_id", "heading_path").agg(F.min("document_order").alias("o"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("o").isNull().alias("no"), "o", "heading_path")))
    h = h.groupBy("doc_id").agg(listed.alias("hs")).select("doc_id", F.size("hs").alias("headings"), F.array_join(F.slice(F.transform("hs", lambda x: x["heading_path"]), 1, HEADINGS), "|").alias("outline"))
    return b.groupBy("doc_id").agg(F.countDistinct("block_id").alias("blocks")).join(h, "doc_id", "left").select("doc_id", "blocks", F.coalesce("headings", F.lit(0)).alias("headings"), "outline")


def search(blocks: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, score, entries: how many headings match each question at which score. Questions are a stated query set,
    matched against the distinct headings only."""
    e = blocks.where("source_type = 'document' AND coalesce(heading_path, '') <> ''").select("doc_id", "heading_path").distinct()
    e = e.withColumns({"term": T.catalog_text(F.element_at(T.heading_parts(F.col("heading_path")), -1)), "h": T.catalog_text(F.col("heading_path"))})
    labels = e.groupBy("term", "h").agg(F.countDistinct(F.concat("doc_id", F.lit("\x1f"), "heading_path")).alias("n"))
    labels = labels.withColumn("lid", F.xxhash64("term", "h"))
    q = questions.select(F.col("id").alias("query_id"), T.catalog_text(F.col("question")).alias("q"))
    ask = q.select(F.col("query_id").alias("hid"), F.col("q").alias("text"))
    own = labels.select(F.col("lid").alias("nid"), F.explode(F.array("term", "h")).alias("needle")).distinct()
    pairs = containing(own, ask).select(F.col("nid").alias("lid"), F.col("hid").alias("query_id"))
    heads = labels.select(F.col("lid").alias("hid"), F.col("h").alias("text"))
    pairs = pairs.unionByName(containing(q.select(F.col("query_id").alias("nid"), F.col("q").alias("needle")), heads).select(F.col("hid").alias("lid"), F.col("nid").alias("query_id"))).distinct()
    score = F.when(F.col("term") == F.col("q"), 1000).when((F.length("term") >= 4) & F.contains("q", "term"), 800).when(F.contains("q", "h") | F.contains("h", "q"), 400).otherwise(0)
    scored = pairs.join(labels, "lid").join(q, "query_id").select("query_id", score.alias("score"), "n").where("score > 0")
    return scored.groupBy("query_id", "score").agg(F.sum("n").alias("entries"))


def read_window(blocks: DataFrame, offset: int, limit: int) -> DataFrame:
    """doc_id, block_id, start, stop: the blocks that overlap a window of the document's reading text. Offsets are running
    sums over lengths, the texts themselves are not moved."""
    b = blocks.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy("doc_id", "block_id").agg(F.first(F.length("text") + F.length(F.coalesce("heading_path", F.lit(""))) + 4).alias("n"), F.min("document_order").alias("o"))
    before = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("o"), "block_id").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("start", F.coalesce(F.sum(F.col("n") + 2).over(before), F.lit(0)).cast("long"))
    return b.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).select("doc_id", "block_id", "start", (F.col("start") + F.col("n")).cast("long").alias("stop"))


def short_context(blocks: DataFrame, short: int = 50, target: int = 120, most: int = 600) -> DataFrame:
    """block_id, context_chars, siblings of the short blocks (see the query)."""
    b = blocks.where("text IS NOT NULL AND block_id IS NOT NULL").groupBy("block_id").agg(F.first("doc_id").alias("doc_id"), F.first("heading_path").alias("h"), F.first(F.length("text")).alias("n"), F.min("document_order").alias("o"), F.first("source_type").alias("st"))
    s = b.where((F.col("n") < short) & (F.col("st") == "document") & (F.coalesce("h", F.lit("")) != "") & F.col("o").isNotNull()).select("block_id", "doc_id", "h", "n", "o")
    x = b.where("o IS NOT NULL").select(F.col("block_id").alias("xb"), "doc_id", "h", F.col("n").alias("xn"), F.col("o").alias("xo"))
    near = Window.partitionBy("block_id").orderBy(F.abs(F.col("xo") - F.col("o")), "xo", "xb")
    j = s.join(x, ["doc_id", "h"]).where("block_id <> xb").withColumn("before", F.sum("xn").over(near) - F.col("xn"))
    j = j.where(F.col("n") + F.col("before") < target)
    return j.groupBy("block_id").agg(F.least(F.lit(most), F.first("n") + F.sum("xn")).cast("long").alias("context_chars"), F.count(F.lit(1)).alias("siblings"))


def distinct_messages(messages: DataFrame, least: int = 20) -> DataFrame:
    """message_id, conversation_id (see the query)."""
    m = messages.where("message_id IS NOT NULL").groupBy("message_id").agg(F.min("conversation_id").alias("conversation_id"), F.min(F.lower(F.trim("role"))).alias("role"), F.min("content").alias("content"), F.min("created_at").alias("t"), F.min("sequence").alias("s"))
    opening = F.coalesce((F.col("s") == 1) & (F.col("role") == "user") & (F.length("content") >= least), F.lit(False))
    first = m.where(opening).groupBy("content").agg(F.min(F.struct(F.col("t").isNull().alias("nt"), "t", "message_id", "conversation_id")).alias("f")).select("f.message_id", "f.conversation_id")
    return m.where(~opening).select("message_id", "conversation_id").unionByName(first)


def history_search(messages: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, message_id, conversation_id of the messages that hold every term of a query (query_id, terms)."""
    m = messages.where("message_id IS NOT NULL AND content IS NOT NULL").groupBy("message_id").agg(F.min("conversation_id").alias("conversation_id"), F.min("content").alias("content"))
    terms = queries.select("query_id", F.size(F.array_distinct("terms")).alias("n"), F.explode(F.array_distinct("terms")).alias("term"))
    postings = m.select("message_id", "conversation_id", F.explode(F.array_distinct(T.tokens(F.col("content")))).alias("term"))
    return postings.join(terms, "term").groupBy("query_id", "message_id").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("conversation_id").alias("conversation_id")).where("k = n").select("query_id", "message_id", "conversation_id")


#: The spellings of a speaker's role (fixed values).
SPEAKERS = {"user": ["user", "human", "用户"], "assistant": ["assistant", "ai", "助手"]}


def speaker(role: Column) -> Column:
    """user or assistant, in whatever spelling; null for all other roles."""
    own = F.lower(F.trim(role))
    return F.when(own.isin(SPEAKERS["user"]), "user").when(own.isin(SPEAKERS["assistant"]), "assistant")


def conversations_with(messages: DataFrame, terms: list[str]) -> DataFrame:
    """conversation_id of the conversations whose messages hold all terms somewhere."""
    has = [F.coalesce(F.bool_or(F.contains(F.lower("content"), F.lit(t))), F.lit(False)).alias(f"has{n}") for n, t in enumerate(terms)]
    found = messages.groupBy("conversation_id").agg(*has)
    return found.where(" AND ".join(f"has{n}" for n in range(len(terms)))).select("conversation_id")


def read_around(messages: DataFrame, centers: Column, before: int, after: int) -> DataFrame:
    """center, message_id, offset. The range condition becomes an equality: each center asks for its few sequence numbers."""
    m = messages.where("sequence IS NOT NULL AND message_id IS NOT NULL AND conversation_id IS NOT NULL").select("conversation_id", "message_id", "sequence").distinct()
    asked = m.where(centers).select("conversation_id", F.col("message_id").alias("center"), F.col("sequence").alias("at"), F.explode(F.sequence(F.col("sequence") - before, F.col("sequence") + after)).alias("sequence"))
    return asked.join(m, ["conversation_id", "sequence"]).select("center", "message_id", (F.col("sequence") - F.col("at")).alias("offset")).distinct()
