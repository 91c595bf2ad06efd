"""Keyed state: latest versions, partial updates, memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, time: str) -> DataFrame:
    """The rows with the latest ``time`` of their key (several if they tie; a null time only if there is no other)."""
    last = df.groupBy(key).agg(F.max(time).alias("_last")).withColumnRenamed(key, "_key")
    return df.join(last, (F.col(key) == F.col("_key")) & F.col(time).eqNullSafe(F.col("_last"))).drop("_key", "_last")


def update_columns(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A partial update by key: columns that ``changes`` has and that are not null there replace the stored ones."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key and c in current.columns])
    joined = current.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in new.columns else F.col(c) for c in current.columns])


def delete(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key), key, "left_anti")


def merge_memories(memories: DataFrame, least: float = 0.5) -> DataFrame:
    """content_key, ids, status, pinned: memories of one category and statement are one; forgotten ones stay forgotten,
    those whose best confidence (clamped to 0..1, null 0) is under ``least`` wait. Rows without id or statement are left out."""
    m = memories.where("id IS NOT NULL AND statement IS NOT NULL").withColumn("st", F.trim(F.regexp_replace(F.lower("statement"), r"\s+", " ")))
    key = F.md5(F.concat(F.coalesce("category", F.lit("")), F.lit("\0"), "st").cast("binary"))
    best = F.max(F.coalesce(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))
    status = F.when(F.coalesce(F.bool_or(F.col("status") == "forgotten"), F.lit(False)), "forgotten").when(best < least, "pending").otherwise("active")
    return m.groupBy(key.alias("content_key")).agg(F.countDistinct("id").alias("ids"), status.alias("status"), F.max(F.coalesce("user_pinned", F.lit(0))).alias("pinned"))
