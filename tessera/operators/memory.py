"""Memories: stored state, life cycle, retrieval, extraction from conversations.

A memory is id, content_hash, category, statement, confidence, status (pending, active, superseded, forgotten, orphaned), pinned,
source conversation and times. Changes are DataFrames of operations; applying them twice changes nothing.

Defined results: forgotten memories never come back; rows without a category or statement are dropped; ties by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.catalog import speaker

#: The categories of memories, and what marks a turn that may hold one (fixed values).
CATEGORIES = "preference fact goal project instruction".split()
MARKERS = ["记住", "记一下", "以后", "总是", "不要", "别再", "我喜欢", "我偏好", "我的", "remember", "always", "never", "prefer", "from now on", "my name", "i am", "i'm"]
LEAST_CONFIDENCE, LEAST_SIMILARITY, CANDIDATES, MATCHES = 0.5, 0.45, 20, 3
INSTRUCTIONS = {"drop": ["不要", "别再", "取消", "do not", "don't", "never"], "change": ["改成", "改为", "换成", "instead", "change"]}


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def identity(category: Column, statement: Column) -> Column:
    """The key that equal memories share."""
    return F.sha2(F.concat(category, F.lit("\0"), plain(statement)), 256)


def confidence(c: Column) -> Column:
    """A number clamped to 0..1; null if it is none."""
    n = c.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.least(F.greatest(n, F.lit(0.0)), F.lit(1.0)))


def upsert(current: DataFrame, changes: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """The stored memories (content_hash, category, statement, confidence, status, pinned, updated_at) after ``changes``
    (category, statement, confidence, at): a new one is active, or pending under ``least``; a known one takes the higher
    confidence and the later time, wakes from pending if that suffices, and stays forgotten or superseded."""
    c = changes.where("coalesce(trim(category), '') <> '' AND coalesce(trim(statement), '') <> ''").select("category", "statement", confidence(F.col("confidence")).alias("confidence"), "at", identity(F.col("category"), F.col("statement")).alias("content_hash"))
    c = c.where("confidence IS NOT NULL").groupBy("content_hash").agg(F.max("confidence").alias("c2"), F.max("at").alias("at"), F.min("category").alias("category2"), F.min("statement").alias("statement2"))
    j = current.join(c, "content_hash", "full_outer")
    best = F.greatest("confidence", "c2")
    status = F.when(F.col("status").isNull(), F.when(best < least, "pending").otherwise("active")).when((F.col("status") == "pending") & (best >= least), "active").otherwise(F.col("status"))
    return j.select("content_hash", F.coalesce("category", "category2").alias("category"), F.coalesce("statement", "statement2").alias("statement"), best.alias("confidence"), status.alias("status"), F.coalesce("pinned", F.lit(0)).alias("pinned"), F.greatest("updated_at", "at").alias("updated_at"))


def mutate(current: DataFrame, operations: DataFrame, applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State (key, statement, status, enabled, revision) and applied operations after ``operations`` (operation_id, seq, kind,
    key, statement, expected). Kinds: add, update, forget, supersede, enable, disable. An operation that was applied before
    (``applied``: operation_id), comes twice, or expects another revision than the stored one does nothing; of several for a
    key the last counts; forgotten keys stay so."""
    fresh = operations.join(applied.select("operation_id").distinct(), "operation_id", "left_anti").groupBy("operation_id").agg(F.min(F.struct("seq", "kind", "key", "statement", "expected")).alias("o")).select("operation_id", "o.*")
    j = fresh.join(current.select("key", F.col("revision").alias("_revision"), F.col("status").alias("_status")), "key", "left")
    ok = j.where((F.col("expected").isNull() | F.col("expected").eqNullSafe(F.col("_revision"))) & ~F.col("_status").eqNullSafe("forgotten") & (F.col("_revision").isNotNull() | (F.col("kind") == "add")))
    last = ok.groupBy("key").agg(F.max_by(F.struct("kind", F.col("statement").alias("text")), F.struct("seq", "operation_id")).alias("l"), F.count(F.lit(1)).alias("steps"))
    s = current.join(last, "key", "full_outer")
    kind = F.col("l.kind")
    status = F.when(kind == "forget", "forgotten").when(kind == "supersede", "superseded").when(kind.isin("add", "update") & ~F.col("status").eqNullSafe("forgotten"), "active").otherwise(F.col("status"))
    enabled = F.when(kind == "enable", True).when(kind == "disable", False).otherwise(F.coalesce("enabled", F.lit(True)))
    text = F.when(kind.isin("add", "update"), F.col("l.text")).otherwise(F.col("statement"))
    state = s.select("key", text.alias("statement"), status.alias("status"), enabled.alias("enabled"), (F.coalesce("revision", F.lit(0)) + F.coalesce("steps", F.lit(0))).cast("long").alias("revision"))
    return state, applied.select("operation_id").union(fresh.select("operation_id")).distinct()


def orphaned(memories: DataFrame, conversations: DataFrame) -> DataFrame:
    """``memories`` with status orphaned where their source conversation is gone, but for forgotten ones and those without one."""
    known = conversations.select(F.col("conversation_id").alias("_known")).distinct()
    j = memories.join(known, F.col("source_conversation_id") == F.col("_known"), "left")
    gone = (F.coalesce("source_conversation_id", F.lit("")) != "") & F.col("_known").isNull() & ~F.col("status").eqNullSafe("forgotten")
    return j.withColumn("status", F.when(gone, "orphaned").otherwise(F.col("status"))).drop("_known")


def index_changes(index: DataFrame, memories: DataFrame) -> DataFrame:
    """id and action (add, update, remove, keep) that bring a vector index (id, content_hash) up to the authoritative memories:
    only active ones stay, each as its latest version."""
    last = memories.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct(F.col("updated_at").isNotNull().alias("t"), "updated_at", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("content_hash", F.lit("")).alias("content_hash"))).alias("r")).select("id", "r.status", F.col("r.content_hash").alias("h"))
    active = last.where("status = 'active'")
    j = index.groupBy("id").agg(F.min(F.coalesce("content_hash", F.lit(""))).alias("i")).join(active, "id", "full_outer")
    action = F.when(F.col("h").isNull(), "remove").when(F.col("i").isNull(), "add").when(F.col("h") != F.col("i"), "update").otherwise("keep")
    return j.select("id", action.alias("action"))


def matches(hits: DataFrame, memories: DataFrame, most: int = MATCHES, least: float = LEAST_SIMILARITY) -> DataFrame:
    """query_id, id, similarity, place of the first ``most`` vector hits (query_id, id, similarity) whose memory is active now (the
    index may be stale) and whose similarity is ``least`` or more."""
    active = index_changes(memories.select("id", "content_hash").limit(0), memories).where("action = 'add'").select("id")
    h = hits.where(F.col("similarity") >= least).join(active, "id", "left_semi")
    return h.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("place") <= most).select("query_id", "id", "similarity", "place")


def has_signal(content: Column, least: int = 6) -> Column:
    """Whether a user's turn may hold something to remember: long enough, with a marker."""
    low, rule = F.lower(content), F.lit(False)
    for m in MARKERS:
        rule |= F.contains(low, F.lit(m))
    return F.coalesce((F.length(F.trim(content)) >= least) & rule, F.lit(False))


def signalled(messages: DataFrame) -> DataFrame:
    """The conversations that have a user's turn with a signal, and how many."""
    m = messages.where("message_id IS NOT NULL AND conversation_id IS NOT NULL").where(speaker(F.col("role")) == "user").where(has_signal(F.col("content")))
    return m.groupBy("conversation_id").agg(F.countDistinct("message_id").alias("turns"))


CANDIDATE = "category:string,statement:string,confidence:string,quote:string,confirmed:boolean"


def parsed(answers: DataFrame, most: int = 8) -> DataFrame:
    """Memories proposed in model answers (answer_id, answer): parsed tolerantly, those of a known category with a statement and a
    number as confidence, unconfirmed ones at half of it, the first ``most`` of an answer. An answer that does not parse has none."""
    from tessera.functions.scalars import json_in

    body = json_in(F.col("answer"))
    listed = F.coalesce(F.from_json(body, f"memories array<struct<{CANDIDATE}>>")["memories"], F.from_json(body, f"array<struct<{CANDIDATE}>>"))
    rows = answers.select("answer_id", F.posexplode(listed).alias("n", "m")).select("answer_id", "n", "m.*")
    ok = rows.where(F.col("category").isin(CATEGORIES) & (F.coalesce(F.trim("statement"), F.lit("")) != "")).withColumn("confidence", confidence(F.col("confidence"))).where("confidence IS NOT NULL")
    ok = ok.withColumn("confidence", F.when(F.coalesce("confirmed", F.lit(False)), F.col("confidence")).otherwise(F.col("confidence") / 2))
    return ok.withColumn("n", F.row_number().over(Window.partitionBy("answer_id").orderBy("n"))).where(F.col("n") <= most).select("answer_id", "n", "category", "statement", "confidence", "quote")


def revocations(messages: DataFrame) -> DataFrame:
    """conversation_id, message_id and kind (drop, change) of the user's turns that take an instruction back."""
    m = messages.where("message_id IS NOT NULL").where(speaker(F.col("role")) == "user").groupBy("conversation_id", "message_id").agg(F.min("content").alias("content"))
    kind = F.lit(None).cast("string")
    for name in reversed(list(INSTRUCTIONS)):
        rule = F.lit(False)
        for w in INSTRUCTIONS[name]:
            rule |= F.contains(F.lower("content"), F.lit(w))
        kind = F.when(rule, name).otherwise(kind)
    return m.select("conversation_id", "message_id", kind.alias("kind")).where("kind IS NOT NULL")


def revoked(requirements: DataFrame, messages: DataFrame) -> DataFrame:
    """requirement_id and the first message (message_id, note) that revoked it: ``messages`` has invalidated ones with the ids
    they revoke (revokes array, sequence, note). Requirements without one have nulls."""
    by = messages.select("message_id", "sequence", "note", F.explode("revokes").alias("requirement_id")).groupBy("requirement_id").agg(F.min(F.struct(F.col("sequence").isNull().alias("late"), "sequence", "message_id", "note")).alias("f"))
    return requirements.select("requirement_id").distinct().join(by, "requirement_id", "left").select("requirement_id", "f.message_id", "f.note")


def snapshot(memories: DataFrame, most: int = 2000) -> DataFrame:
    """category, text and more: the statements of the active memories, pinned and newest first, that fit ``most`` characters with
    their line ends, and how many do not."""
    once = memories.where("status = 'active' AND id IS NOT NULL AND statement IS NOT NULL").groupBy("category", "id").agg(F.max(F.struct(F.coalesce("user_pinned", F.lit(0)).alias("p"), "updated_at", "statement")).alias("r")).select("category", "id", "r.*")
    order = Window.partitionBy("category").orderBy(F.desc("p"), F.desc_nulls_last("updated_at"), "id")
    once = once.withColumns({"n": F.row_number().over(order), "s": F.sum(F.length("statement") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    line = F.when(F.col("s") <= most, F.struct("n", "statement"))
    return once.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["statement"]), "\n").alias("text"), F.count_if(F.col("s") > most).alias("more"))
