"""Conversations and their messages: ranked search, pages, lists, forks and cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.scalars import within_days
from tessera.operators import catalog, lexical
from tessera.session import numbered

RANK = ["query_id", "message_id", "score", "created_at", "sequence"]


def once(messages: DataFrame) -> DataFrame:
    """Each message once: the earliest delivery (created_at with nulls last, then content, sequence). Rows without an id are
    left out."""
    r = F.struct(F.col("created_at").isNull().alias("late"), "created_at", "content", "sequence", "role", "conversation_id")
    return messages.where("message_id IS NOT NULL").groupBy("message_id").agg(F.min(r).alias("r")).select("message_id", "r.conversation_id", "r.role", "r.content", "r.created_at", "r.sequence")


def postings(messages: DataFrame) -> DataFrame:
    """The full-text index: term, message_id, tf, dl. Built once for a corpus, stored, and searched by ``search``."""
    return lexical.term_counts(messages.where("content IS NOT NULL"), "message_id", "content").where(F.col("term") != lexical.RECORD)


def search(messages: DataFrame, queries: DataFrame, start: str | None = None, end: str | None = None, least: int = 20) -> DataFrame:
    """query_id, message_id, conversation_id, score, created_at, sequence and position of the messages that hold every term of a
    query (query_id, question), by BM25 over all messages, then newest, then sequence and id. Repeated long openings of
    conversations count once (the earliest). Days from ``start`` to ``end``, both included. A query without terms finds nothing."""
    m = once(messages)
    q = queries.select("query_id", F.array_distinct(T.tokens(F.col("question"))).alias("terms")).where("size(terms) > 0")
    asked = q.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    counts = lexical.term_counts(m.where("content IS NOT NULL"), "message_id", "content", asked.select("term").distinct())
    stats = counts.where(F.col("term") == lexical.RECORD).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    own = counts.where(F.col("term") != lexical.RECORD)
    idf = lexical.with_idf(own.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats).select("term", "idf", "avgdl")
    norm = F.col("tf") + lexical.K1 * (1 - lexical.B + lexical.B * F.col("dl") / F.col("avgdl"))
    hit = own.join(asked.withColumnRenamed("n", "wanted"), "term").join(idf, "term").groupBy("query_id", "message_id").agg(F.round(F.sum(F.col("idf") * F.col("tf") * (lexical.K1 + 1) / norm), 6).alias("score"), F.count(F.lit(1)).alias("k"), F.first("wanted").alias("wanted")).where("k = wanted")
    kept = catalog.distinct_messages(messages, least).select("message_id")
    found = hit.join(m, "message_id").join(kept, "message_id", "left_semi")
    if start or end:
        found = found.where(within_days(F.col("created_at").cast("timestamp"), start, end))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("created_at"), F.asc_nulls_last("sequence"), "message_id")
    return found.select("query_id", "message_id", "conversation_id", "score", "created_at", "sequence").withColumn("position", F.row_number().over(order))


def scanned(messages: DataFrame, terms: list[str]) -> DataFrame:
    """message_id, matched (how many of the terms), created_at of the messages with one at least, in one order: matched, newest,
    id. All messages are read, so nothing is cut off."""
    m = once(messages).where("content IS NOT NULL")
    low = F.lower("content")
    matched = sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    rows = m.select("message_id", matched.alias("matched"), "created_at").where("matched > 0")
    return numbered(rows, "position", F.desc("matched"), F.desc_nulls_last("created_at"), F.asc("message_id"))


def excerpt(text: Column, terms: Column, width: int = 80) -> Column:
    """A window around the earliest of the terms (a column of words), with ellipses where it is cut."""
    places = F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), t)), lambda p: p > 0)
    at = F.coalesce(F.array_min(places), F.lit(1))
    start = F.greatest(at - width // 2, F.lit(1))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substr(text, start, F.lit(width)), F.when(start + width - 1 < F.length(text), "…").otherwise(""))


def summaries(messages: DataFrame) -> DataFrame:
    """conversation_id, message_count, updated_at, last_sequence and title (the first words of its first user message)."""
    m = once(messages).where("conversation_id IS NOT NULL")
    user = catalog.speaker(F.col("role")) == "user"
    opening = F.min(F.when(user & F.col("content").isNotNull(), F.struct(F.col("sequence").isNull().alias("n"), "sequence", "message_id", "content")))
    g = m.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("message_count"), F.max("created_at").alias("updated_at"), F.max("sequence").alias("last_sequence"), opening.alias("o"))
    return g.select("conversation_id", "message_count", "updated_at", "last_sequence", F.substring(F.trim(F.regexp_replace("o.content", r"\s+", " ")), 1, 30).alias("title"))


def sidebar(conversations: DataFrame) -> DataFrame:
    """``conversations`` (summaries) with place: latest activity first, then the longer one, then id."""
    return numbered(conversations, "place", F.desc_nulls_last("updated_at"), F.desc_nulls_last("last_sequence"), F.asc("conversation_id"))


def visible(conversations: DataFrame, archived: DataFrame) -> DataFrame:
    """The conversations that have messages and are not archived (conversation_id)."""
    return conversations.where("message_count > 0").join(archived.select("conversation_id").distinct(), "conversation_id", "left_anti")


def archive(conversations: DataFrame, archived: DataFrame) -> DataFrame:
    """The archived ones (conversation_id, archived_at) of ``conversations``, latest first by archive time, else last activity."""
    j = conversations.join(archived.groupBy("conversation_id").agg(F.max("archived_at").alias("archived_at")), "conversation_id")
    return numbered(j, "place", F.desc_nulls_last(F.coalesce("archived_at", "updated_at")), F.asc("conversation_id"))


def titled(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """``rows`` with the titles of their conversations; unknown ones have none."""
    return rows.join(conversations.select("conversation_id", "title"), "conversation_id", "left")


def fork(messages: DataFrame, conversation: str, new: str, before: int) -> DataFrame:
    """``messages`` and a copy of a conversation's messages before a sequence number, under a new conversation."""
    own = messages.where((F.col("conversation_id") == conversation) & (F.col("sequence") < before))
    copy = own.withColumns({"conversation_id": F.lit(new), "message_id": F.concat(F.lit(new + ":"), F.col("message_id"))})
    return messages.unionByName(copy)


def delete_conversations(messages: DataFrame, gone: DataFrame, *dependent: tuple[DataFrame, str]) -> tuple[DataFrame, list[DataFrame]]:
    """The messages without those of the conversations that go, and each dependent table with its reference to them null."""
    left = messages.join(gone.select("conversation_id").distinct(), "conversation_id", "left_anti")
    out = []
    for table, column in dependent:
        keys = gone.select(F.col("conversation_id").alias("_gone")).distinct()
        j = table.join(keys, F.col(column) == F.col("_gone"), "left")
        out.append(j.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone"))
    return left, out


def truncate(messages: DataFrame, cuts: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages below their conversation's cut (conversation_id, cut), and ``runs`` (with message_id) whose reference to a
    message that went is null."""
    j = messages.join(cuts, "conversation_id", "left")
    kept = j.where(F.col("cut").isNull() | F.coalesce(F.col("sequence") < F.col("cut"), F.lit(True))).drop("cut")
    gone = j.where(F.col("cut").isNotNull() & (F.col("sequence") >= F.col("cut"))).select(F.col("message_id").alias("_gone")).distinct()
    r = runs.join(gone, F.col("message_id") == F.col("_gone"), "left")
    return kept, r.withColumn("message_id", F.when(F.col("_gone").isNull(), F.col("message_id"))).drop("_gone")


def missing_index(messages: DataFrame, index: DataFrame, fingerprint: str, built_with: str) -> DataFrame:
    """One row: missing and orphaned messages of an index (message_id), and whether it must be built anew."""
    m, i = messages.where("content IS NOT NULL").select("message_id").distinct(), index.select("message_id").distinct()
    j = m.withColumn("m", F.lit(True)).join(i.withColumn("i", F.lit(True)), "message_id", "full_outer")
    g = j.agg(F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("m").isNull()).alias("orphaned"))
    return g.withColumn("rebuild", (F.col("missing") > 0) | (F.col("orphaned") > 0) | F.lit(fingerprint != built_with))
