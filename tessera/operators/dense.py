"""Exact vector search of a stated query set against all rows.

Queries are held in blocks of QUERY_BLOCK vectors (a proven bound for the broadcast); each block is one pass over the rows,
multiplied as matrices in Arrow batches; a batch keeps its best k per query, so the shuffle carries k rows per batch and query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096


def checked(queries: DataFrame, vector: str, dim: int) -> DataFrame:
    """``queries``, failing where a vector is null, empty, zero, not finite or of another dimension than ``dim``."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) == dim) & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return queries.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"a query vector is not usable: {dim} finite numbers, not all zero, are needed")).cast("boolean")))


def top_k(spark: SparkSession, rows: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 20, block: int = QUERY_BLOCK) -> DataFrame:
    """query, key, similarity (cosine, 6 decimals), rank; ties by key. Null, empty, zero and non-finite vectors, and such of another dimension than the queries (that of most of them), have no hits; ``checked`` refuses such queries."""
    usable = queries.where(F.col(query_vector).isNotNull() & (F.size(query_vector) > 0)).select(F.col(query_key).alias("q"), F.col(query_vector).alias("v"))
    blocks = max(1, -(-usable.count() // block))
    kind, qkind = rows.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    first = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = first["d"] if first else 0
    out = None
    for n in range(blocks):
        own = usable.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n).collect()
        own = [r for r in own if len(r["v"]) == dim]
        ids = [r["q"] for r in own]
        m = np.array([r["v"] for r in own], float).reshape(len(own), dim)
        length = np.linalg.norm(m, axis=1)
        good = np.isfinite(length) & (length > 0)
        shared = spark.sparkContext.broadcast(([i for i, g in zip(ids, good, strict=True) if g], m[good] / length[good, None], dim))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m, dim = shared.value
            for frame in frames:
                frame = frame[[v is not None and len(v) == dim for v in frame["v"]]]
                if not len(frame) or not len(ids):
                    continue
                x = np.stack(frame["v"].to_numpy()).astype(float)
                length = np.linalg.norm(x, axis=1)
                good = np.isfinite(length) & (length > 0)
                keys = frame["k"].to_numpy()[good]
                if not len(keys):
                    continue
                sim = np.round(m @ (x[good] / length[good, None]).T, 6)
                for i, row in enumerate(sim):
                    best = np.arange(len(keys))
                    if len(keys) > k:  # all ties with the k-th stay: the final order decides
                        best = np.flatnonzero(row >= np.partition(row, len(keys) - k)[len(keys) - k])
                    yield pd.DataFrame({"q": [ids[i]] * len(best), "k": keys[best], "similarity": row[best]})

        found = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, f"q {qkind}, k {kind}, similarity double")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "k")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("k").alias(key), "similarity", "rank")
