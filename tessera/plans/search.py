"""Queries: lexical, dense and fused search, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import dense, fusion, lexical
from tessera.plans.catalog import query
from tessera.tables import table

DOC_TOKENS = f"d AS (SELECT doc_id AS k, {T.tokens_sql('text')} AS toks FROM documents)"
STATS = "s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d)"
BLOCK_TOKENS = f"d AS (SELECT block_id AS k, {T.tokens_sql('text')} AS toks FROM cb)"
POSTINGS = "p AS (SELECT k, len(any_value(toks)) AS dl, term, count(*) AS tf FROM (SELECT k, toks, unnest(toks) AS term FROM d) GROUP BY k, term)"
QUERIES_SQL = f"""
q0 AS (SELECT id AS query_id, list_distinct({T.tokens_sql('question')}) AS terms, {T.tokens_sql('question')} AS seq FROM eval_questions),
q1 AS (SELECT *, list_filter(list_transform(generate_series(1, len(seq)), lambda i: CASE WHEN list_position(seq, seq[i]) = i AND NOT ({T.low_information_sql('seq[i]')}) THEN seq[i] END), lambda x: x IS NOT NULL) AS inf FROM q0),
q2 AS (SELECT *, len(terms) AS query_terms, len(inf) AS informative_query_terms, len(list_filter(inf, lambda t: {T.is_identifier_sql('t')})) AS identifier_query_terms,
              inf[1:least(6, greatest(1, ceil(len(inf) * 0.4)))::INT] AS anchors FROM q1),
q AS (SELECT query_id, query_terms, informative_query_terms, identifier_query_terms, len(anchors) AS anchor_query_terms, anchors, unnest(terms) AS term FROM q2)"""
SCORED = f"""
f AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
i AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, n, avgdl FROM f, s),
h AS (SELECT query_id, k, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, count(*) AS matched_terms, any_value(query_terms) AS query_terms,
             round(sum(idf) / count(*) / any_value(ln(1 + (n - 0.5) / 0.5)), 6) AS rarity,
             count(*) FILTER (NOT ({T.low_information_sql('term')})) AS informative_matched_terms, any_value(informative_query_terms) AS informative_query_terms,
             count(*) FILTER (NOT ({T.low_information_sql('term')}) AND {T.is_identifier_sql('term')}) AS identifier_matched_terms, any_value(identifier_query_terms) AS identifier_query_terms,
             count(*) FILTER (list_contains(anchors, term)) AS anchor_matched_terms, any_value(anchor_query_terms) AS anchor_query_terms
      FROM p JOIN q USING (term) JOIN i USING (term) GROUP BY query_id, k),
r AS (SELECT *, round(matched_terms / query_terms, 6) AS coverage, round(CASE WHEN informative_query_terms > 0 THEN informative_matched_terms / informative_query_terms ELSE 0 END, 6) AS informative_coverage,
             row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k) AS rank FROM h WHERE score > 0)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_questions").select(F.col("id").alias("query_id"), "question")


@query("bm25_topk", f"WITH {DOC_TOKENS}, {STATS}, {POSTINGS}, {QUERIES_SQL}, {SCORED} SELECT query_id, k AS doc_id, score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of every question."""
    return lexical.search(table(spark, d, "documents"), "doc_id", "text", questions(spark, d), "query_id", "question", 10).select("query_id", "doc_id", "score", "rank")


EVIDENCE = ["query_id", "doc_id", "rank", "coverage", "rarity", "informative_matched_terms", "informative_query_terms", "informative_coverage", "identifier_matched_terms", "identifier_query_terms", "anchor_matched_terms", "anchor_query_terms"]


@query("bm25_evidence", f"WITH {DOC_TOKENS}, {STATS}, {POSTINGS}, {QUERIES_SQL}, {SCORED} SELECT k AS doc_id, {', '.join(c for c in EVIDENCE if c != 'doc_id')} FROM r WHERE rank <= 50")
def bm25_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, rarity, identifier and anchor evidence of the fifty best documents of every question."""
    return lexical.search(table(spark, d, "documents"), "doc_id", "text", questions(spark, d), "query_id", "question", 50).select(*EVIDENCE)


@query("bm25_stats", f"WITH {DOC_TOKENS} SELECT count(*) AS n, round(avg(len(toks)), 6) AS avgdl, sum(len(toks)) AS tokens FROM d")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.size(T.tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.sum("dl").alias("tokens"))


@query("doc_freq", f"WITH {DOC_TOKENS}, {STATS}, u AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM d) GROUP BY term) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM u, s")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequency(table(spark, d, "documents"), "doc_id", "text").withColumn("idf", F.round("idf", 6))


DENSE = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
c AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a, v b WHERE a.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM c)"""


def vectors(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return dense.top_k(spark, e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), "vec_id", "embedding", k)


@query("dense_topk", f"WITH {DENSE} SELECT query_id, vec_id, similarity, rank FROM t WHERE rank <= 20")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The twenty nearest vectors of every query vector (those whose id is divisible by 50), exactly."""
    return vectors(spark, d, 20)


@query("dense_gate", f"WITH {DENSE} SELECT query_id, vec_id, similarity, rank FROM t WHERE rank <= 20 AND similarity >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5")
def dense_gate(spark: SparkSession, d: str) -> DataFrame:
    """Of the twenty nearest the five best above a least similarity."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return vectors(spark, d, 20).where("similarity >= 0.2").withColumn("n", F.row_number().over(w)).where("n <= 5").drop("n")


@query("self_probe", f"WITH {DENSE}, a AS (SELECT query_id, similarity AS own FROM c WHERE query_id = vec_id) SELECT query_id, max(CASE WHEN vec_id = query_id OR similarity = own THEN 1 ELSE 0 END) = 1 AS reachable FROM (SELECT * FROM t WHERE rank <= 8) JOIN a USING (query_id) GROUP BY query_id")
def self_probe(spark: SparkSession, d: str) -> DataFrame:
    """Whether each query vector is found by itself among the best eight (or tied with the vector that is)."""
    return vectors(spark, d, 8).groupBy("query_id").agg((F.max(F.when((F.col("vec_id") == F.col("query_id")) | (F.col("similarity") >= 1.0), 1).otherwise(0)) == 1).alias("reachable"))


@query("integrity_report", "SELECT count(*) AS logical, count(DISTINCT vec_id) AS unique_ids, count(*) FILTER (embedding IS NULL) AS missing, count(*) FILTER (len(embedding) <> 64) AS wrong_dimension, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite FROM embeddings")
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("logical"), F.countDistinct("vec_id").alias("unique_ids"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.count_if(F.size("embedding") != 64).alias("wrong_dimension"), F.count_if(bad).alias("not_finite"))


CANONICAL = """
b0 AS (SELECT *, CASE WHEN trim(coalesce(text, ''), E' \\t\\n\\r') = '' THEN block_id ELSE md5(trim(text, E' \\t\\n\\r')) END AS th,
              coalesce(nullif(chunk_type, ''), 'text') AS ct,
              CASE WHEN trim(coalesce(heading_path, ''), E' \\t\\n\\r') = '' THEN '__unheaded__' ELSE trim(regexp_replace(lower(heading_path), '\\s+', ' ', 'g')) END AS hk,
              len(list_filter(string_split(coalesce(source_file, ''), '/'), lambda x: regexp_full_match(x, '[0-9a-fA-F]{32}'))) AS legacy,
              len(list_filter(string_split(coalesce(source_file, ''), '/'), lambda x: x <> '')) AS depth FROM blocks WHERE block_id IS NOT NULL),
b1 AS (SELECT *, first_value(block_id) OVER (PARTITION BY th, ct, hk ORDER BY legacy, depth, length(coalesce(source_file, '')), lower(coalesce(source_file, '')), block_id) AS canonical_id FROM b0)"""


@query("canonical_blocks", f"WITH {CANONICAL} SELECT DISTINCT block_id, canonical_id FROM b1")
def canonical_blocks(spark: SparkSession, d: str) -> DataFrame:
    """block_id and the block that stands for all with its text, type and heading."""
    return fusion.canonical(table(spark, d, "blocks")).select("block_id", "canonical_id").distinct()


CB = f"{CANONICAL}, cb AS (SELECT block_id, any_value(text) AS text FROM blocks WHERE block_id IN (SELECT canonical_id FROM b1) GROUP BY block_id)"
FUSED = f"""{CB}, {BLOCK_TOKENS}, {STATS}, {POSTINGS}, {QUERIES_SQL}, {SCORED},
lex AS (SELECT query_id, k AS block_id, rank AS lexical_rank, score AS bm25_score, rarity, coverage, matched_terms, informative_matched_terms, informative_query_terms, informative_coverage, identifier_matched_terms, identifier_query_terms, anchor_matched_terms, anchor_query_terms FROM r WHERE rank <= 50),
den0 AS (SELECT b1.canonical_id AS block_id, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY round(similarity, 6) DESC, b1.block_id) AS rank
         FROM (SELECT block_id, any_value(canonical_id) AS canonical_id, max(similarity) AS similarity FROM b1 GROUP BY block_id) b1 WHERE similarity IS NOT NULL),
den AS (SELECT block_id, min(rank) AS dense_rank, max(similarity) AS dense_similarity FROM den0 WHERE rank <= 400 GROUP BY block_id),
fu0 AS (SELECT q.query_id, block_id FROM (SELECT DISTINCT query_id FROM q0) q, den UNION SELECT query_id, block_id FROM lex),
fu AS (SELECT query_id, block_id, dense_rank, dense_similarity, lexical_rank, bm25_score, round(coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + lexical_rank), 0), 9) AS rrf_score,
              rarity, informative_matched_terms, informative_query_terms, informative_coverage, identifier_matched_terms, identifier_query_terms, anchor_matched_terms
       FROM fu0 LEFT JOIN den USING (block_id) LEFT JOIN lex USING (query_id, block_id)),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, block_id) AS rrf_rank FROM fu)"""


@query("rrf_fuse", f"WITH {FUSED} SELECT query_id, block_id, dense_rank, dense_similarity, lexical_rank, bm25_score, rrf_score, rrf_rank FROM rr")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal-rank fusion of a lexical and a dense route over canonical blocks. The stored similarity is the dense route
    of every question (the table holds one retrieval's scores); its rank counts duplicates before they collapse."""
    return fusion.fuse(table(spark, d, "blocks"), questions(spark, d)).select("query_id", "block_id", "dense_rank", "dense_similarity", "lexical_rank", "bm25_score", "rrf_score", "rrf_rank")


@query("rrf_fuse_search")
def rrf_fuse_search(spark: SparkSession, d: str) -> DataFrame:
    """The same with a dense search for every question, over embedded blocks (an embedder: no SQL; tested against numpy)."""
    return fusion.fuse(table(spark, d, "blocks"), questions(spark, d), spark).select("query_id", "block_id", "dense_rank", "dense_similarity", "lexical_rank", "bm25_score", "rrf_score", "rrf_rank")


GATED = f"""{FUSED},
g0 AS (SELECT *, cb.text, {T.numeric_noise_sql('cb.text')} AS noise, coalesce(lexical_rank <= 15 AND rarity >= 0.2 AND CASE
         WHEN identifier_query_terms > 0 AND identifier_matched_terms = 0 THEN false
         WHEN identifier_matched_terms > 0 THEN informative_query_terms = identifier_query_terms OR (informative_matched_terms > identifier_matched_terms
              AND NOT (informative_query_terms >= 8 AND informative_coverage < 0.3 AND informative_matched_terms < 6 AND coalesce(dense_similarity < 0.35, true)))
         WHEN informative_query_terms >= 8 AND informative_coverage < 0.3 AND NOT (dense_similarity IS NOT NULL AND informative_matched_terms >= 6) THEN false
         WHEN informative_query_terms = 1 AND informative_matched_terms = 1 THEN true
         WHEN informative_matched_terms < 2 THEN false
         ELSE informative_coverage >= 0.25 OR informative_matched_terms >= 3 END, false) AS rescue FROM rr JOIN cb USING (block_id)),
g1 AS (SELECT *, CASE
         WHEN rescue AND dense_similarity IS NULL AND informative_query_terms >= 8 AND anchor_matched_terms = 0 THEN 'rejected_lexical_only_missing_anchor'
         WHEN rescue AND dense_similarity < 0.5 AND informative_matched_terms <= 3 AND NOT (informative_matched_terms >= 3 AND informative_coverage >= 0.3 AND rarity >= 0.6 AND anchor_matched_terms >= 1) THEN 'rejected_low_quality_lexical_fill'
         WHEN rescue AND dense_similarity IS NULL THEN 'accepted_lexical_only'
         WHEN rescue AND dense_similarity < 0.35 THEN 'rejected_lexical_dense_contradiction'
         WHEN rescue AND dense_similarity >= 0.45 THEN 'accepted_lexical_rescue'
         WHEN rescue THEN 'accepted_lexical_override'
         WHEN dense_similarity IS NULL THEN 'rejected_missing_dense_weak_lexical'
         WHEN dense_similarity < 0.6 + CASE WHEN lexical_rank IS NULL THEN 0.05 ELSE 0 END + CASE WHEN noise THEN 0.1 ELSE 0 END THEN CASE WHEN noise THEN 'rejected_numeric_noise_below_threshold' ELSE 'rejected_dense_below_threshold' END
         WHEN lexical_rank IS NULL THEN 'accepted_dense_only' ELSE 'accepted_dense_with_weak_lexical' END AS reason FROM g0)"""


@query("candidate_gate", f"WITH {GATED} SELECT query_id, block_id, rescue, reason, starts_with(reason, 'accepted') AS accepted FROM g1")
def candidate_gate(spark: SparkSession, d: str) -> DataFrame:
    """Rescue and gate decision of every fused candidate, with the reason."""
    b = table(spark, d, "blocks")
    return fusion.gate(fusion.fuse(b, questions(spark, d)), b).select("query_id", "block_id", "rescue", "reason", F.startswith("reason", F.lit("accepted")).alias("accepted"))


@query("lexical_fallback", f"""WITH {GATED}, none AS (SELECT query_id FROM g1 GROUP BY query_id HAVING count(*) FILTER (starts_with(reason, 'accepted')) = 0)
    SELECT query_id, block_id, rrf_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_rank) AS n FROM g1 JOIN none USING (query_id)
    WHERE rescue AND informative_matched_terms >= 3 AND anchor_matched_terms >= 1 AND lexical_rank <= 5 AND reason NOT IN ('rejected_lexical_dense_contradiction', 'rejected_low_quality_lexical_fill', 'rejected_numeric_noise_below_threshold')) WHERE n <= 3""")
def lexical_fallback(spark: SparkSession, d: str) -> DataFrame:
    """For questions without an accepted candidate, up to three strong lexical ones."""
    b = table(spark, d, "blocks")
    return fusion.fallback(fusion.gate(fusion.fuse(b, questions(spark, d)), b)).select("query_id", "block_id", "rrf_rank")


@query("select_context")
def select_context(spark: SparkSession, d: str) -> DataFrame:
    """The final rows of every question under the quotas (order-dependent: no SQL)."""
    b = table(spark, d, "blocks")
    return fusion.select_context(fusion.gate(fusion.fuse(b, questions(spark, d), spark), b), b)


@query("where_filter", "SELECT block_id, source_type, document_order FROM blocks WHERE source_type = 'document' AND (chunk_type IN ('text', 'table') OR match_type = 'hybrid')")
def where_filter(spark: SparkSession, d: str) -> DataFrame:
    """The predicate language compiled to a column."""
    b = table(spark, d, "blocks")
    return b.where(fusion.where(b, {"$and": [{"source_type": "document"}, {"$or": [{"chunk_type": {"$in": ["text", "table"]}}, {"match_type": {"$eq": "hybrid"}}]}]})).select("block_id", "source_type", "document_order")
