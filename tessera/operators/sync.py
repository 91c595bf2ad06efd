"""Incremental synchronisation: what changed, which blocks keep their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def path_priority(path: str = "path"):
    """Plain paths before hash-named folders, short before deep, then by name."""
    parts = F.split(path, "/")
    return F.struct(F.size(F.filter(parts, lambda x: x.rlike("^[0-9a-fA-F]{32}$"))).alias("legacy"), F.size(parts).alias("depth"), F.length(path).alias("n"), F.lower(path).alias("l"), F.col(path).alias("p"))


def canonical_paths(files: DataFrame) -> DataFrame:
    """content_hash and the path that stands for it (an aggregate with partial results: copies never meet in one task)."""
    return files.where("content_hash IS NOT NULL AND path IS NOT NULL").groupBy("content_hash").agg(F.min(path_priority()).alias("b")).select("content_hash", F.col("b.p").alias("path"))


def diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """path and action of two manifests (path, content_hash, mtime, size): added, updated, touched, unchanged, duplicate, deleted."""
    b = before.select(F.col("path").alias("bp"), F.col("content_hash").alias("bh"), F.col("mtime").alias("bm"), F.col("size").alias("bs"))
    canonical = canonical_paths(now).select(F.col("content_hash").alias("ch"), F.col("path").alias("canonical"))
    n = now.join(canonical, F.col("content_hash") == F.col("ch"), "left")
    action = (
        F.when(F.col("path").isNull(), "deleted").when(F.col("canonical") != F.col("path"), "duplicate").when(F.col("bp").isNull(), "added")
        .when((F.col("bm") == F.col("mtime")) & (F.col("bs") == F.col("size")), "unchanged").when(F.col("bh") == F.col("content_hash"), "touched").otherwise("updated")
    )
    return b.join(n, F.col("bp") == F.col("path"), "full_outer").select(F.coalesce("bp", "path").alias("path"), action.alias("action"))


def reuse(old: DataFrame, new: DataFrame) -> DataFrame:
    """block_id of every new block and the old block of equal text whose vector it takes over (one taker per text)."""
    first = old.groupBy("doc_id", "h").agg(F.min("block_id").alias("old_id"))
    taker = new.groupBy("doc_id", "h").agg(F.min("block_id").alias("taker"))
    matched = taker.join(first, ["doc_id", "h"]).select(F.col("taker").alias("block_id"), F.col("old_id").alias("reused"))
    return new.select("block_id").join(matched, "block_id", "left")


def merge(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """An idempotent upsert: rows of ``changes`` replace those with their key."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def number_within(df: DataFrame, group: str, *order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
