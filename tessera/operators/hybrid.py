"""Hybrid search of a batch of questions: variants, a dense and a lexical route for each, scope, fusion, gates, anchors, trace.

Every question has its original wording, its plain form and, if it asks for a definition, the name (see functions/queries). Each
wording is searched densely (not the name) and lexically; ranks are taken before copies collapse into canonical blocks; the
routes are fused by reciprocal rank. One run gives candidates, context and trace.

Scope: a predicate on the blocks. Corpus statistics cover all blocks; hits outside the scope are dropped before ranking, and
again after it against the blocks themselves, so a stale vector cannot leave the scope.

Defined results: empty questions find nothing; missing evidence stays null; ties go by block id.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions import queries as Q
from tessera.functions import text as T
from tessera.operators import dense, fusion, lexical
from tessera.session import cut

DIM = 64
LEXICAL_RESERVE, DENSE_RESERVE, NEAR = 3, 2, 0.05
#: What shows that a text defines a name: words after it, and words of headings (fixed values).
DEFINES, DEFINING_HEADINGS = "是|指|即|全称是|全称为|属于|代表", "定义|简介|概述|是什么|什么意思|全称"


def hashed_embedding(c: Column, dim: int = DIM) -> Column:
    """A deterministic unit vector of a text: counts of its tokens (found in the JVM) by the first byte of their MD5, in Arrow
    batches; zeros for a text without tokens."""

    @pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def one(tokens) -> np.ndarray:
            for t in tokens:
                if t not in known:
                    known[t] = md5(t.encode()).digest()[0] % dim
            v = np.bincount([known[t] for t in tokens], minlength=dim).astype(float) if len(tokens) else np.zeros(dim)
            length = np.sqrt(v @ v)
            return v / length if length else v

        return texts.map(one)

    return run(T.tokens(c))


def scope_of(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """The blocks of the wanted documents (doc_id). Fails if one of them has no block: a scope must not silently shrink."""
    wanted = documents.select("doc_id").distinct()
    missing = unresolved(blocks, wanted)
    n = missing.count()
    if n:
        raise ValueError(f"{n} documents of the scope are unknown, such as {missing.first()['doc_id']}")
    return blocks.join(wanted, "doc_id", "left_semi")


def unresolved(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """The wanted documents (doc_id) that have no block."""
    return documents.select("doc_id").distinct().join(blocks.select("doc_id").distinct(), "doc_id", "left_anti")


def routes(spark: SparkSession, blocks: DataFrame, questions: DataFrame, scope: Column | None = None, variants: bool = True, dense_window: int = fusion.DENSE_WINDOW, lexical_window: int = fusion.LEXICAL_WINDOW) -> DataFrame:
    """query_id, route (dense or lexical with the number of the wording), block_id (canonical), rank, similarity, and the
    lexical evidence of a hit. ``questions`` has query_id and question."""
    worded = Q.variants(questions, "query_id", "question") if variants else questions.where("trim(question) <> ''").select("query_id", F.lit(0).alias("ord"), F.lit("original").alias("kind"), F.trim("question").alias("text"))
    worded = cut(spark, worded.withColumn("wid", F.concat("query_id", F.lit("\x1f"), F.col("ord").cast("string"))), "wordings")
    mapped = cut(spark, fusion.canonical(blocks if scope is None else blocks.where(scope)).groupBy("block_id").agg(F.min("canonical_id").alias("canonical_id")), "canonical")
    texts = blocks.where("block_id IS NOT NULL").groupBy("block_id").agg(F.first("text", ignorenulls=True).alias("text"))
    inside = texts.join(mapped.select("block_id"), "block_id", "left_semi")
    asked = worded.where("kind <> 'definition_subject'").select("wid", hashed_embedding(F.col("text")).alias("v"))
    near = dense.top_k(spark, inside.select("block_id", hashed_embedding(F.col("text")).alias("v")), "block_id", "v", asked, "wid", "v", dense_window).withColumnRenamed("query_id", "wid")
    ids = mapped.select(F.col("canonical_id").alias("block_id")).distinct()
    every = texts.join(fusion.canonical(blocks).select(F.col("canonical_id").alias("block_id")).distinct(), "block_id", "left_semi") if scope is not None else texts.join(ids, "block_id", "left_semi")
    found = lexical.search(every, "block_id", "text", worded.select("wid", "text"), "wid", "text", lexical_window, ids if scope is not None else None)
    evidence = [c for c in found.columns if c not in ("wid", "block_id", "rank", "score")]
    both = near.select("wid", "block_id", "rank", "similarity", F.lit("dense").alias("by")).unionByName(found.select("wid", "block_id", "rank", F.col("score").alias("bm25"), F.lit("lexical").alias("by"), *evidence), allowMissingColumns=True)
    own = both.join(mapped, "block_id").join(worded.select("wid", "query_id", "ord", "kind"), "wid")
    best = own.groupBy("query_id", F.concat("by", F.lit(":"), F.col("ord").cast("string")).alias("route"), F.col("canonical_id").alias("block_id")).agg(
        F.min("rank").alias("rank"), F.max("similarity").alias("similarity"), F.max("bm25").alias("bm25"), *[F.min_by(c, F.struct("rank", "block_id")).alias(c) for c in evidence]
    )
    return best


def fuse(routed: DataFrame) -> DataFrame:
    """query_id, block_id with rrf_score, rrf_rank, the best evidence of either kind, whether a lexical route rescues it, and
    the signals of all routes."""
    c = F.col
    lex, den = F.startswith("route", F.lit("lexical")), F.startswith("route", F.lit("dense"))
    dense_best = F.max(F.when(den, c("similarity"))).over(Window.partitionBy("query_id", "block_id"))
    one = routed.withColumns({"dense_similarity": dense_best, "lexical_rank": F.when(lex, c("rank")), "points": 1 / (fusion.RRF_K + c("rank"))})
    one = one.withColumn("rescues", lex & fusion.rescue())
    evidence = ["rarity", "informative_matched_terms", "informative_query_terms", "informative_coverage", "identifier_matched_terms", "identifier_query_terms", "anchor_matched_terms"]
    first = F.struct(~c("rescues"), "rank", "route")  # evidence of a rescuing route before that of others
    got = one.groupBy("query_id", "block_id").agg(
        F.round(F.sum("points"), 9).alias("rrf_score"), F.max("dense_similarity").alias("dense_similarity"), F.min(F.when(den, c("rank"))).alias("dense_rank"),
        F.min("lexical_rank").alias("lexical_rank"), F.max("bm25").alias("bm25_score"), F.coalesce(F.bool_or("rescues"), F.lit(False)).alias("rescue"),
        *[F.min_by(F.when(lex, c(e)), F.when(lex, first)).alias(e) for e in evidence],
        F.array_sort(F.collect_list(F.struct("route", "rank"))).alias("signals"),
    )
    return got.withColumn("rrf_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "block_id")))


def defines(text: Column, headings: Column, subject: Column) -> Column:
    """Whether a text says what ``subject`` is: in words after it, in brackets after it, or under a heading of definitions."""
    name = F.concat(F.lit("(?i)\\Q"), subject, F.lit("\\E"))
    said = F.regexp_like(text, F.concat(name, F.lit(f"\\s*(?:{DEFINES})"))) | F.regexp_like(text, F.concat(name, F.lit("\\s*[（(【\\[][^）)】\\]\\n]{2,80}[）)】\\]]")))
    headed = F.regexp_like(F.concat_ws("\n", headings, text), name) & headings.rlike(DEFINING_HEADINGS)
    return F.coalesce(subject.isNotNull() & (said | headed), F.lit(False))


def anchors(gated: DataFrame, blocks: DataFrame, questions: DataFrame, top_k: int = 8, per_parent: int = 3, per_source: int = 8) -> DataFrame:
    """query_id, block_id, place and reserve of the accepted candidates in the order they are offered: up to LEXICAL_RESERVE
    rescued ones, then up to DENSE_RESERVE of the best similarity, one of a heading each, then the others by fused rank; prose
    changes places with a picture of its heading if its evidence is stronger; for a definition question texts that define the
    name come first. A query has a bounded number of candidates."""
    about = blocks.groupBy("block_id").agg(F.first("heading_path", ignorenulls=True).alias("heading"), F.first("source_file", ignorenulls=True).alias("source"), F.first("chunk_type", ignorenulls=True).alias("kind"))
    subject = questions.select("query_id", Q.subject(F.col("question")).alias("subject"))
    rows = gated.where(F.startswith("reason", F.lit("accepted"))).join(about, "block_id").join(subject, "query_id", "left")
    rows = rows.withColumn("defining", defines(F.col("text"), F.concat_ws("\n", "heading", "source"), F.col("subject")))
    rows = rows.select("query_id", "block_id", "rrf_rank", "rrf_score", "dense_similarity", "lexical_rank", "rescue", "informative_coverage", "informative_matched_terms", "identifier_matched_terms", "heading", "source", "kind", "subject", "defining")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.astype(object).where(frame.notna(), None).sort_values(["rrf_rank", "block_id"]).to_dict("records")
        sim = lambda r: -1.0 if r["dense_similarity"] is None else r["dense_similarity"]

        def reserve(candidates: list[dict], most: int) -> list[dict]:
            taken, heads, parents, sources = [], set(), {}, {}
            for r in candidates:
                source, heading = r["source"] or "", r["heading"] or ""
                head, parent = (source, heading or r["block_id"]), (source, heading.rpartition(" > ")[0])
                if len(taken) < most and head not in heads and parents.get(parent, 0) < per_parent and sources.get(source, 0) < per_source:
                    taken.append(r)
                    heads.add(head)
                    parents[parent], sources[source] = parents.get(parent, 0) + 1, sources.get(source, 0) + 1
            return taken

        strong = sorted((r for r in rows if r["rescue"]), key=lambda r: (not r["identifier_matched_terms"], -(r["informative_coverage"] or 0), -(r["informative_matched_terms"] or 0), r["lexical_rank"], r["dense_similarity"] is None, -r["rrf_score"], r["block_id"]))
        first = reserve(strong, min(LEXICAL_RESERVE, top_k))
        close = sorted((r for r in rows if r["dense_similarity"] is not None and r not in first), key=lambda r: (-r["dense_similarity"], -r["rrf_score"], r["block_id"]))
        second = reserve(close, min(DENSE_RESERVE, max(0, top_k - len(first))))
        mark = {r["block_id"]: "lexical" for r in first} | {r["block_id"]: "dense" for r in second}
        order = [*first, *second, *(r for r in rows if r["block_id"] not in mark)]
        rank = lambda r: r["lexical_rank"] if r["rescue"] else 999
        for i, picture in enumerate(order):
            if picture["kind"] != "image_description" or not (picture["heading"] or "").strip():
                continue
            for j in range(i + 1, len(order)):
                prose = order[j]
                same = prose["kind"] in ("text", "table") and (prose["source"], prose["heading"]) == (picture["source"], picture["heading"])
                stronger = sim(prose) > sim(picture) and prose["rrf_score"] > picture["rrf_score"]
                if same and (stronger or (prose["dense_similarity"] is not None and sim(prose) >= max(sim(picture), 0.0) - NEAR and rank(prose) < rank(picture))):
                    order[i], order[j] = prose, picture
                    if picture["block_id"] in mark and prose["block_id"] not in mark:
                        mark[prose["block_id"]] = mark.pop(picture["block_id"])
                    break
        if rows[0]["subject"]:
            order.sort(key=lambda r: not r["defining"])
        return pd.DataFrame([(r["query_id"], r["block_id"], n, mark.get(r["block_id"], "none")) for n, r in enumerate(order, 1)], columns=["query_id", "block_id", "place", "reserve"])

    return rows.groupBy("query_id").applyInPandas(run, "query_id string, block_id string, place int, reserve string")


def retrieve(spark: SparkSession, blocks: DataFrame, questions: DataFrame, scope: Column | None = None, variants: bool = True, top_k: int = 8) -> tuple[DataFrame, DataFrame]:
    """The context (query_id, block_id, position, reason) and the trace of every candidate: its signals, gate reason, place
    among the anchors, reserve and what became of it; no texts and no paths. If no candidate of a question is accepted, up to
    three strong lexical ones are taken."""
    gated = cut(spark, fusion.gate(fuse(routes(spark, blocks, questions, scope, variants)), blocks), "gated")
    spare = fusion.fallback(gated).select("query_id", "block_id", F.lit(True).alias("spare"))
    gated = gated.join(spare, ["query_id", "block_id"], "left").withColumn("reason", F.when(F.col("spare"), "accepted_fallback").otherwise(F.col("reason"))).drop("spare")
    placed = cut(spark, anchors(gated, blocks, questions, top_k), "anchors")
    offered = gated.join(placed.select("query_id", "block_id", "place"), ["query_id", "block_id"], "left").withColumn("rrf_rank", F.coalesce("place", F.lit(1 << 20) + F.col("rrf_rank")))
    context = cut(spark, fusion.select_context(offered, blocks, top_k), "context")
    trace = gated.select("query_id", "block_id", "rrf_rank", "rrf_score", "dense_rank", "dense_similarity", "lexical_rank", "bm25_score", "rescue", "signals", F.col("reason").alias("gate"))
    trace = trace.join(placed, ["query_id", "block_id"], "left").join(context.select("query_id", "block_id", "position", F.col("reason").alias("selected")), ["query_id", "block_id"], "left")
    return context, trace
