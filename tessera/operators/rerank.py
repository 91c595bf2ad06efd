"""Reranking: checked requests and answers, scores, containment classes, profiles.

Requests are query_id, candidate_id, scope_id, index_revision, ranking_text, payload_hash; answers query_id, candidate_id,
score. Nothing is passed on unfiltered: a batch that does not hold its contract is 'failed' as a whole.

Defined results: a batch without candidates is 'empty'; nulls in any checked column break the contract; ties by candidate_id.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

MIN_CANDIDATES, TOKEN_BUDGET = 1, 30_000


def ranking_text(name: Column, heading: Column, text: Column) -> Column:
    """What a candidate is scored by: three lines of a fixed form."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("文档："), e(name), F.lit("\n标题："), e(heading), F.lit("\n内容："), e(text))


def checked(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """query_id, candidates and status of every batch against its snapshot (query_id, scope_id, index_revision): ok, empty,
    duplicate_id, scope_mismatch, version_changed or incomplete. Queries of the snapshot without candidates are empty."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    s = snapshots.select("query_id", F.col("scope_id").alias("_scope"), F.col("index_revision").alias("_revision"))
    j = s.join(requests, "query_id", "left")
    has = F.col("candidate_id").isNotNull() | F.col("ranking_text").isNotNull()
    g = j.groupBy("query_id").agg(
        F.count_if(has).alias("candidates"), (F.count("candidate_id") - F.countDistinct("candidate_id")).alias("repeated"), F.coalesce(F.bool_or(has & ~F.col("scope_id").eqNullSafe(F.col("_scope"))), F.lit(False)).alias("scope"),
        F.coalesce(F.bool_or(has & ~F.col("index_revision").eqNullSafe(F.col("_revision"))), F.lit(False)).alias("revision"),
        F.coalesce(F.bool_or(has & (blank("candidate_id") | blank("ranking_text") | ~F.coalesce(F.col("payload_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)))), F.lit(False)).alias("incomplete"),
    )
    status = F.when(F.col("candidates") == 0, "empty").when(F.col("repeated") > 0, "duplicate_id").when(F.col("scope"), "scope_mismatch").when(F.col("revision"), "version_changed").when(F.col("incomplete"), "incomplete").otherwise("ok")
    return g.select("query_id", "candidates", status.alias("status"))


def coverage_score(query: Column, text: Column) -> Column:
    """The default scorer: the share of the query's distinct tokens that the text has."""
    q = F.array_distinct(T.tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.tokens(text))) / F.size(q)).otherwise(0.0)


def scored_by(requests: DataFrame, provider: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """query_id, candidate_id, score of an own provider, called once for each batch with the question and its texts in order of
    the ids. A provider that fails or gives another number of scores leaves nulls, which fail the batch."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("candidate_id")
        try:
            scores = [float(x) for x in provider(frame["question"].iloc[0], frame["ranking_text"].tolist())]
        except Exception:  # noqa: BLE001 - one batch must not end the job
            scores = []
        if len(scores) != len(frame):
            scores = [math.nan] * len(frame)
        return pd.DataFrame({"query_id": frame["query_id"], "candidate_id": frame["candidate_id"], "score": scores})

    kinds = {c: requests.schema[c].dataType.simpleString() for c in ("query_id", "candidate_id")}
    return requests.select("query_id", "candidate_id", "question", "ranking_text").groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, candidate_id {kinds['candidate_id']}, score double")


def answered(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id and status of every batch: ok if the answers are exactly the candidates, once each, with scores from 0 to 1;
    else missing, foreign, repeated or out_of_range."""
    a = answers.groupBy("query_id", "candidate_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("score").between(0.0, 1.0) & ~F.isnan("score"), F.lit(False))).alias("fits"))
    r = requests.select("query_id", "candidate_id").distinct().withColumn("asked", F.lit(True))
    g = r.join(a, ["query_id", "candidate_id"], "full_outer").groupBy("query_id").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("asked").isNull()).alias("foreign"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count_if(~F.col("fits")).alias("unfit"))
    status = F.when(F.col("missing") > 0, "missing").when(F.col("foreign") > 0, "foreign").when(F.col("most") > 1, "repeated").when(F.col("unfit") > 0, "out_of_range").otherwise("ok")
    return g.select("query_id", status.alias("status"))


def shrunk(candidates: DataFrame, budget: int = TOKEN_BUDGET, least: int = MIN_CANDIDATES) -> DataFrame:
    """The first candidates of each query (query_id, rrf_rank, candidate_id, tokens) that fit ``budget`` tokens together, but
    never fewer than ``least``."""
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("rrf_rank"), "candidate_id")
    c = candidates.withColumns({"_sum": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(order)})
    return c.where((F.col("_sum") <= budget) | (F.col("_n") <= least)).drop("_sum", "_n")


def classes(views: DataFrame) -> DataFrame:
    """``views`` (query_id, candidate_id, block_id, start, stop, score) with class_id, the largest view of the same block that
    contains it (itself if none does; of equal spans the smallest id), and whether it represents its class (best score, then the
    larger span, then id). Spans of a block and query are few, so they meet in an equality join."""
    other = views.select("query_id", "block_id", F.col("candidate_id").alias("_id"), F.col("start").alias("_a"), F.col("stop").alias("_b"))
    j = views.join(other, ["query_id", "block_id"]).where("_a <= start AND stop <= _b")
    top = j.groupBy("query_id", "candidate_id").agg(F.min(F.struct((F.col("_a") - F.col("_b")).alias("n"), "_a", F.col("_id").alias("class_id"))).alias("t")).select("query_id", "candidate_id", "t.class_id")
    best = Window.partitionBy("query_id", "class_id").orderBy(F.desc_nulls_last("score"), F.col("start") - F.col("stop"), "candidate_id")
    return views.join(top, ["query_id", "candidate_id"]).withColumn("represents", F.row_number().over(best) == 1)


def outcome(checks: DataFrame, answers: DataFrame, selected: DataFrame, enabled: bool = True) -> DataFrame:
    """query_id and the pipeline's status: disabled, failed (a contract was broken), empty (nothing to score or nothing kept) or
    filtered."""
    kept = selected.where("selected").groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))
    j = checks.join(answers.withColumnRenamed("status", "answer"), "query_id", "left").join(kept, "query_id", "left")
    status = F.when(F.lit(not enabled), "disabled").when(F.col("status") == "empty", "empty").when((F.col("status") != "ok") | ~F.col("answer").eqNullSafe("ok"), "failed").when(F.coalesce("kept", F.lit(0)) == 0, "empty").otherwise("filtered")
    return j.select("query_id", status.alias("status"))


def ordered(scored: DataFrame) -> DataFrame:
    """The final order: score, fused score, id, sequence."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("rrf_score"), "candidate_id")
    return scored.withColumn("final_rank", F.row_number().over(w))


def corpus_identity(ids: DataFrame, column: str = "block_id") -> DataFrame:
    """One row: a hash over the hashes of the sorted distinct ids in 256 buckets (two levels, so no task holds all ids)."""
    b = ids.where(F.col(column).isNotNull()).select(F.col(column).alias("i")).distinct().withColumn("b", F.substring(F.sha2("i", 256), 1, 2))
    k = b.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("i")), "\n"), 256).alias("h")).select(F.concat("b", F.lit(":"), "h").alias("k"))
    return k.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("revision"))


def drifted(profiles: DataFrame, ids: DataFrame, column: str = "block_id") -> DataFrame:
    """``profiles`` (with corpus_revision) and needs_validation: whether the corpus is no longer the one they were made on."""
    now = corpus_identity(ids, column)
    return profiles.join(F.broadcast(now)).withColumn("needs_validation", ~F.col("corpus_revision").eqNullSafe(F.col("revision"))).drop("revision")
