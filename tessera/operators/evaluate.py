"""Retrieval quality."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE_BLOCK = 16_000_000


def containing(docs: DataFrame, key: str, text: str, passages: DataFrame, passage_key: str, passage: str, block: int = PASSAGE_BLOCK) -> DataFrame:
    """``passage_key`` and ``key`` of the documents that hold a passage verbatim. The passages are a stated query set in blocks
    of ``block`` characters (the bound of what is broadcast); each block is one pass over the texts with a multi-pattern
    automaton, nothing else is shuffled than the hits. Empty passages are in every text; nulls in none."""
    import ahocorasick

    spark = docs.sparkSession
    own = passages.where(F.col(passage).isNotNull()).select(F.col(passage_key).alias("q"), F.col(passage).alias("p")).distinct()
    blocks = max(1, -(-(own.agg(F.sum(F.length("p"))).first()[0] or 0) // block))
    kind, qkind = docs.schema[key].dataType.simpleString(), passages.schema[passage_key].dataType.simpleString()
    out = None
    for n in range(blocks):
        by: dict[str, list] = {}
        for q, p in own.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == n).collect():
            by.setdefault(p, []).append(q)
        shared = spark.sparkContext.broadcast(by)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            by, machine = shared.value, ahocorasick.Automaton()
            for p, qs in by.items():
                if p:
                    machine.add_word(p, qs)
            if len(machine):
                machine.make_automaton()
            for frame in frames:
                rows = set()
                for k, t in zip(frame["k"], frame["t"], strict=True):
                    rows.update((q, k) for q in by.get("", ()))
                    if len(machine):
                        rows.update((q, k) for _, qs in machine.iter(t) for q in qs)
                yield pd.DataFrame(list(rows), columns=["q", "k"])

        hit = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"q {qkind}, k {kind}")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct().select(F.col("q").alias(passage_key), F.col("k").alias(key))


def judged(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """hits (query_id, key, rank) with rel (1 or 0) by joining targets (query_id, key)."""
    t = targets.select("query_id", "key").distinct().withColumn("rel", F.lit(1))
    return hits.join(t, ["query_id", "key"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(judged_hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """query_id, hit1, hit5, hitk, rr, ndcg: ``wanted`` has query_id and n (targets of the query); queries without hits count 0."""
    rel = F.when((F.col("rel") == 1) & (F.col("rank") <= k), F.col("rank"))
    m = judged_hits.groupBy("query_id").agg(F.min(rel).alias("first"), F.sum(F.when(rel.isNotNull(), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    m = wanted.where("n > 0").join(m, "query_id", "left")
    hit = lambda at: F.coalesce((F.col("first") <= at).cast("int"), F.lit(0))
    return m.select("query_id", hit(1).alias("hit1"), hit(5).alias("hit5"), hit(k).alias("hitk"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))
