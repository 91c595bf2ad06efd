"""Fusing routes, gating and selecting candidates, for batches of queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.embed import embedding
from tessera.operators import dense, lexical
from tessera.session import cut

RRF_K, DENSE_WINDOW, LEXICAL_WINDOW = 60, 400, 50
RESCUE_RANK, MIN_RARITY, MIN_COVERAGE, LONG_COVERAGE, LONG_TERMS, ESCAPE = 15, 0.20, 0.25, 0.30, 8, 6
MIN_SIMILARITY, DENSE_ONLY, NUMERIC, OVERRIDE, REFINE, REFINE_TERMS, FLOOR, EXPAND = 0.60, 0.05, 0.10, 0.35, 0.50, 3, 0.45, 0.68
VETOES = ["rejected_lexical_dense_contradiction", "rejected_low_quality_lexical_fill", "rejected_numeric_noise_below_threshold"]
SPACE = " \t\n\r"


def where(df: DataFrame, predicate: dict) -> Column:
    """A predicate ({column: value}, {column: {"$eq" or "$in": ...}}, {"$and" or "$or": [...]}) as a column.
    Null equals null. An unknown operator or column makes the whole false."""

    def one(p: dict) -> Column:
        out = F.lit(True)
        for k, v in p.items():
            if k in ("$and", "$or"):
                parts = [one(x) for x in v]
                c = parts[0] if parts else F.lit(k == "$and")
                for x in parts[1:]:
                    c = (c & x) if k == "$and" else (c | x)
            elif k.startswith("$") or k not in df.columns:
                c = F.lit(False)
            elif isinstance(v, dict):
                c = F.lit(True)
                for op, x in v.items():
                    c &= F.col(k).eqNullSafe(x) if op == "$eq" else F.coalesce(F.col(k).isin(x), F.lit(False)) if op == "$in" and x else F.lit(False)
            else:
                c = F.col(k).eqNullSafe(v)
            out &= c
        return out

    return one(predicate)


def canonical(blocks: DataFrame) -> DataFrame:
    """block_id, canonical_id, similarity: blocks of equal text, type and heading collapse to the one with the plainest
    path (fewest hash-named folders, shortest, then by name and id). The minimum is taken before the shuffle (partial
    aggregation), so a group of copies of any size is one row per task."""
    text, heading = F.trim(F.coalesce("text", F.lit("")), F.lit(SPACE)), F.trim(F.coalesce("heading_path", F.lit("")), F.lit(SPACE))
    parts = F.split(F.coalesce("source_file", F.lit("")), "/")
    b = blocks.where("block_id IS NOT NULL").select(
        "block_id", F.round("similarity", 6).alias("similarity"),
        F.when(text == "", F.col("block_id")).otherwise(F.md5(text.cast("binary"))).alias("th"),
        F.coalesce(F.nullif("chunk_type", F.lit("")), F.lit("text")).alias("ct"),
        F.when(heading == "", F.lit("__unheaded__")).otherwise(F.trim(F.regexp_replace(F.lower("heading_path"), r"\s+", " "))).alias("hk"),
        F.struct(
            F.size(F.filter(parts, lambda x: x.rlike("^[0-9a-fA-F]{32}$"))).alias("legacy"), F.size(F.filter(parts, lambda x: x != "")).alias("depth"),
            F.length(F.coalesce("source_file", F.lit(""))).alias("n"), F.lower(F.coalesce("source_file", F.lit(""))).alias("s"), F.col("block_id").alias("id"),
        ).alias("priority"),
    )
    best = b.groupBy("th", "ct", "hk").agg(F.min("priority").alias("best"))
    return b.join(best, ["th", "ct", "hk"]).select("block_id", F.col("best.id").alias("canonical_id"), "similarity")


def _dense_route(mapped: DataFrame) -> DataFrame:
    """block_id (canonical), dense_rank, dense_similarity of the first DENSE_WINDOW rows. The top rows are taken with a
    distributed limit first; only they are numbered."""
    top = mapped.groupBy("block_id").agg(F.first("canonical_id").alias("canonical_id"), F.max("similarity").alias("similarity")).where("similarity IS NOT NULL")
    top = top.orderBy(F.desc("similarity"), "block_id").limit(DENSE_WINDOW)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "block_id")))
    return top.groupBy(F.col("canonical_id").alias("block_id")).agg(F.min("rank").alias("dense_rank"), F.max("similarity").alias("dense_similarity"))


def search_route(spark: SparkSession, blocks: DataFrame, queries: DataFrame, mapped: DataFrame) -> DataFrame:
    """query_id, block_id (canonical), dense_rank, dense_similarity of each query's own DENSE_WINDOW nearest blocks; questions
    and blocks are embedded and searched exactly."""
    rows = blocks.where("block_id IS NOT NULL").groupBy("block_id").agg(F.min("text").alias("text")).select("block_id", embedding("text").alias("v"))
    hits = dense.top_k(spark, rows, "block_id", "v", queries.select("query_id", embedding("question").alias("v")), "query_id", "v", DENSE_WINDOW)
    hits = hits.join(mapped.groupBy("block_id").agg(F.first("canonical_id").alias("canonical_id")), "block_id")
    return hits.groupBy("query_id", F.col("canonical_id").alias("block_id")).agg(F.min("rank").alias("dense_rank"), F.max("similarity").alias("dense_similarity"))


def fuse(blocks: DataFrame, queries: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """query_id, block_id with the ranks and scores of both routes, rrf_score and rrf_rank; missing evidence stays null. The
    dense route is the stored similarity, the same for every query; with ``spark`` it is a search for each query."""
    mapped = cut(blocks.sparkSession, canonical(blocks), "canonical")
    ids = mapped.select(F.col("canonical_id").alias("block_id")).distinct()
    texts = blocks.groupBy("block_id").agg(F.first("text", ignorenulls=True).alias("text"))
    lex = lexical.search(texts.join(ids, "block_id", "left_semi"), "block_id", "text", queries, "query_id", "question", LEXICAL_WINDOW)
    lex = lex.withColumnsRenamed({"rank": "lexical_rank", "score": "bm25_score"})
    den = search_route(spark, blocks, queries, mapped) if spark else queries.select("query_id").join(F.broadcast(_dense_route(mapped)))  # at most DENSE_WINDOW rows for each query
    both = den.join(lex, ["query_id", "block_id"], "full_outer")
    score = F.coalesce(1 / (RRF_K + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1 / (RRF_K + F.col("lexical_rank")), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "block_id")
    return both.withColumn("rrf_score", F.round(score, 9)).withColumn("rrf_rank", F.row_number().over(order))


def rescue() -> Column:
    """Whether a lexical hit may stand without dense support."""
    c = F.col
    long = (c("informative_query_terms") >= LONG_TERMS) & (c("informative_coverage") < LONG_COVERAGE)
    named = (c("informative_query_terms") == c("identifier_query_terms")) | ((c("informative_matched_terms") > c("identifier_matched_terms")) & ~(long & (c("informative_matched_terms") < ESCAPE) & F.coalesce(c("dense_similarity") < OVERRIDE, F.lit(True))))
    rule = (
        F.when((c("identifier_query_terms") > 0) & (c("identifier_matched_terms") == 0), False)
        .when(c("identifier_matched_terms") > 0, named)
        .when(long & ~(c("dense_similarity").isNotNull() & (c("informative_matched_terms") >= ESCAPE)), False)
        .when((c("informative_query_terms") == 1) & (c("informative_matched_terms") == 1), True)
        .when(c("informative_matched_terms") < 2, False)
        .otherwise((c("informative_coverage") >= MIN_COVERAGE) | (c("informative_matched_terms") >= 3))
    )
    return F.coalesce((c("lexical_rank") <= RESCUE_RANK) & (c("rarity") >= MIN_RARITY) & rule, F.lit(False))


def gate(fused: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds text, noise, rescue and the reason of the decision."""
    texts = blocks.groupBy("block_id").agg(F.first("text", ignorenulls=True).alias("text"))
    f = fused.join(texts, "block_id").withColumns({"noise": T.numeric_noise(F.col("text"))} | ({} if "rescue" in fused.columns else {"rescue": rescue()}))
    c, sim, lex = F.col, F.col("dense_similarity"), F.col("lexical_rank")
    strong = (c("informative_matched_terms") >= 3) & (c("informative_coverage") >= LONG_COVERAGE) & (c("rarity") >= 0.60) & (c("anchor_matched_terms") >= 1)
    least = F.lit(MIN_SIMILARITY) + F.when(lex.isNull(), DENSE_ONLY).otherwise(0.0) + F.when(c("noise"), NUMERIC).otherwise(0.0)
    reason = (
        F.when(c("rescue") & sim.isNull() & (c("informative_query_terms") >= LONG_TERMS) & (c("anchor_matched_terms") == 0), "rejected_lexical_only_missing_anchor")
        .when(c("rescue") & (sim < REFINE) & (c("informative_matched_terms") <= REFINE_TERMS) & ~strong, "rejected_low_quality_lexical_fill")
        .when(c("rescue") & sim.isNull(), "accepted_lexical_only")
        .when(c("rescue") & (sim < OVERRIDE), "rejected_lexical_dense_contradiction")
        .when(c("rescue") & (sim >= FLOOR), "accepted_lexical_rescue")
        .when(c("rescue"), "accepted_lexical_override")
        .when(sim.isNull(), "rejected_missing_dense_weak_lexical")
        .when(sim < least, F.when(c("noise"), "rejected_numeric_noise_below_threshold").otherwise("rejected_dense_below_threshold"))
        .when(lex.isNull(), "accepted_dense_only")
        .otherwise("accepted_dense_with_weak_lexical")
    )
    return f.withColumn("reason", reason)


def fallback(gated: DataFrame, most: int = 3) -> DataFrame:
    """The strong lexical candidates of queries that have no accepted one."""
    none = gated.groupBy("query_id").agg(F.count_if(F.startswith("reason", F.lit("accepted"))).alias("n")).where("n = 0").select("query_id")
    ok = F.col("rescue") & (F.col("informative_matched_terms") >= 3) & (F.col("anchor_matched_terms") >= 1) & (F.col("lexical_rank") <= 5) & ~F.col("reason").isin(VETOES)
    w = Window.partitionBy("query_id").orderBy("rrf_rank")
    return gated.join(none, "query_id", "left_semi").where(ok).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def select_context(gated: DataFrame, blocks: DataFrame, top_k: int = 8, per_heading: int = 2, per_parent: int = 3, per_source: int | None = None) -> DataFrame:
    """query_id, block_id, position, reason: up to ``top_k`` rows per query.

    A row that one quota turns away must not use up another, so this is a fold over the candidates of a query in order; a
    query has at most DENSE_WINDOW + LEXICAL_WINDOW candidates. Accepted candidates first (by fused rank) under the quotas
    per heading, parent section and source; one place is kept for a sibling from the section of a candidate with a
    similarity of EXPAND or more; what the quotas deferred fills up.
    """
    about = blocks.groupBy("block_id").agg(F.first("heading_path", ignorenulls=True).alias("heading"), F.first("source_file", ignorenulls=True).alias("source"), F.first("chunk_type", ignorenulls=True).alias("kind"))
    rows = gated.select("query_id", "block_id", "rrf_rank", "reason", "dense_similarity").join(about, "block_id")
    limit = per_source or top_k

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rrf_rank", "block_id"])
        rows = [dict(zip(frame.columns, r, strict=True)) for r in frame.itertuples(index=False)]
        for r in rows:
            heading, source = r["heading"] or "", r["source"] or ""
            r["by"] = ((source, heading or r["block_id"]), (source, heading.rpartition(" > ")[0]), source)
        accepted = [r for r in rows if r["reason"].startswith("accepted")]
        open_sections = {r["by"][1] for r in accepted if r["dense_similarity"] is not None and r["dense_similarity"] >= EXPAND}
        siblings = [r for r in rows if r["by"][1] in open_sections and r["kind"] != "image_description"]
        open_sections = {s for s in open_sections if sum(r["by"][1] == s for r in siblings) > 1}
        room = max(1, top_k - 1) if open_sections and top_k >= 3 else top_k
        counts: dict = {}
        out, later, seen = [], [], set()

        def put(r: dict, reason: str, sections: bool) -> None:
            out.append((r["query_id"], r["block_id"], len(out) + 1, reason))
            seen.add(r["block_id"])
            for level, k in enumerate(r["by"]):
                if sections or level == 2:
                    counts[level, k] = counts.get((level, k), 0) + 1

        for r in accepted:
            full = any(counts.get((level, k), 0) >= most for level, (k, most) in enumerate(zip(r["by"], (per_heading, per_parent, limit), strict=True)))
            if len(out) < room and not full:
                put(r, "anchor", True)
            else:
                later.append(r)
        for r in siblings:
            if len(out) < top_k and r["block_id"] not in seen and r["by"][1] in open_sections and r["reason"] not in VETOES and counts.get((2, r["by"][2]), 0) < limit:
                put(r, "parent_section_expansion", False)
        for r in later:
            if len(out) < top_k and r["block_id"] not in seen and counts.get((2, r["by"][2]), 0) < limit:
                put(r, "diversity_backfill", False)
        return pd.DataFrame(out, columns=["query_id", "block_id", "position", "reason"])

    return rows.groupBy("query_id").applyInPandas(run, "query_id string, block_id string, position int, reason string")
