import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions.embed import embed
from tessera.functions.vectors import cosine
from tessera.operators import catalog, dense, evidence, fusion, lexical, store, sync


def test_bm25_against_hand_computation(spark):
    docs = [(1, "alpha beta beta"), (2, "alpha gamma"), (3, "delta"), (4, None)]
    d = spark.createDataFrame(docs, "k int, t string")
    q = spark.createDataFrame([("q", "beta alpha"), ("none", "zeta"), ("empty", "")], "query_id string, question string")
    got = {(r["query_id"], r["k"]): r for r in lexical.search(d, "k", "t", q, "query_id", "question", 5).collect()}
    assert set(got) == {("q", 1), ("q", 2)}
    n, avg = 4, 6 / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    score = lambda parts, dl: sum(idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)) for df, tf in parts)
    assert got["q", 1]["score"] == pytest.approx(score([(1, 2), (2, 1)], 3), abs=1e-6)
    assert got["q", 2]["score"] == pytest.approx(score([(2, 1)], 2), abs=1e-6)
    assert got["q", 1]["rank"] == 1 and got["q", 1]["coverage"] == 1.0


def test_bm25_empty_corpus(spark):
    d = spark.createDataFrame([], "k int, t string")
    q = spark.createDataFrame([("q", "a")], "query_id string, question string")
    assert lexical.search(d, "k", "t", q, "query_id", "question").count() == 0


def test_dense_against_numpy(spark):
    r = np.random.default_rng(1)
    m = r.normal(size=(60, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(98, None), (99, []), (100, [0.0] * 8), (101, [float("nan")] * 8), (102, [1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    got = dense.top_k(spark, df, "id", "v", df.where("id % 20 = 0"), "id", "v", 5, block=2).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        want = sorted(range(60), key=lambda i: (-round(float(u[q] @ u[i]), 6), i))[:5]
        assert [x["id"] for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == want
    assert {x["query_id"] for x in got} == {0, 20, 40}


def test_cosine_guard(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([], [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(25 / (25 + 1e-9)) and got[1] == 0.0


def test_where(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "x string, n int")
    f = lambda p: [r["x"] for r in df.where(fusion.where(df, p)).collect()]
    assert f({"n": None}) == ["b"]
    assert f({"$or": [{"x": "a"}, {"n": {"$eq": None}}]}) == ["a", "b"]
    assert f({"x": {"$gt": "a"}}) == [] and f({"nope": 1}) == [] and f({"x": {"$in": ["b"]}}) == ["b"] and f({"x": {"$in": []}}) == []


def test_canonical_blocks(spark):
    rows = [("b1", " t ", "text", "A > B", "x/" + "0" * 32 + "/f.md", 0.5), ("b2", "t", "text", "a >  b", "x/f.md", None), ("b3", "t", "table", "A > B", "x/f.md", 0.1), ("b4", "", None, None, None, None), ("b5", "", None, None, None, None)]
    df = spark.createDataFrame(rows, "block_id string, text string, chunk_type string, heading_path string, source_file string, similarity double")
    got = {r["block_id"]: r["canonical_id"] for r in fusion.canonical(df).collect()}
    assert got == {"b1": "b2", "b2": "b2", "b3": "b3", "b4": "b4", "b5": "b5"}


def test_selection_respects_quotas_and_order(spark):
    gated = [("q", f"b{i:02}", i, "accepted_dense_only", 0.65, ) for i in range(1, 13)]
    g = spark.createDataFrame(gated, "query_id string, block_id string, rrf_rank int, reason string, dense_similarity double").repartition(4)
    b = spark.createDataFrame([(f"b{i:02}", "A > B" if i < 5 else f"A > C{i}", "f.md", "text") for i in range(1, 13)], "block_id string, heading_path string, source_file string, chunk_type string")
    got = sorted((r["position"], r["block_id"], r["reason"]) for r in fusion.select_context(g, b).collect())
    assert [x[1] for x in got[:3]] == ["b01", "b02", "b05"] and len(got) == 8
    assert {x[2] for x in got[3:]} == {"diversity_backfill"}


def test_fusion_searches_for_each_question(spark):
    texts = {"b1": "alpha beta gamma", "b2": "delta epsilon", "b3": "alpha delta", "b4": "alpha beta gamma", "b5": None}
    b = spark.createDataFrame([(k, t, "text", "h", f"{k}.md", 0.5) for k, t in texts.items()], "block_id string, text string, chunk_type string, heading_path string, source_file string, similarity double")
    questions = {"q1": "alpha beta", "q2": "epsilon", "q3": ""}
    q = spark.createDataFrame(list(questions.items()), "query_id string, question string")
    got = {(r["query_id"], r["block_id"]): (r["dense_rank"], r["dense_similarity"]) for r in fusion.fuse(b, q, spark).collect()}
    want = {}
    for i, question in questions.items():
        v = embed(question)
        hits = sorted((-round(float(v @ embed(t)), 6), k) for k, t in texts.items() if t and v.any())
        for rank, (sim, k) in enumerate(hits, 1):
            want.setdefault((i, "b1" if k == "b4" else k), (rank, -sim))
    assert got == want and got["q1", "b1"] != got["q2", "b1"]


def test_conversation_search_takes_every_spelling_of_a_role(spark, tmp_path):
    roles = ["AI", "ai", "Human", " human", "用户", "助手", "user", "Assistant ", "tool", "?", None]
    rows = [(f"c{n}", r, "the glossary and the Budget") for n, r in enumerate(roles)] + [("d", "用户", "glossary"), ("d", "AI", "budget"), ("e", "AI", "budget")]
    spark.createDataFrame(rows, "conversation_id string, role string, content string").write.parquet(f"{tmp_path}/history_messages.parquet")
    got = {r[0] for r in entry.queries()["conversation_search_all"](spark, str(tmp_path)).collect()}
    assert got == {f"c{n}" for n in range(8)} | {"d"}


def test_sync_actions(spark):
    cols = "path string, content_hash string, mtime double, size long"
    before = spark.createDataFrame([("same", "1", 1.0, 1), ("touched", "2", 1.0, 1), ("edited", "3", 1.0, 1), ("gone", "4", 1.0, 1)], cols)
    now = spark.createDataFrame([("same", "1", 1.0, 1), ("touched", "2", 2.0, 1), ("edited", "x", 2.0, 1), ("new", "5", 1.0, 1), ("dir/" + "a" * 32 + "/new", "5", 1.0, 1)], cols)
    got = {r["path"]: r["action"] for r in sync.diff(before, now).collect()}
    assert got == {"same": "unchanged", "touched": "touched", "edited": "updated", "gone": "deleted", "new": "added", "dir/" + "a" * 32 + "/new": "duplicate"}


def test_merge_is_idempotent(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = sync.merge(a, c, "k")
    assert sorted(map(tuple, sync.merge(once, c, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    part = spark.createDataFrame([(1, None), (2, "z")], "k int, v string")
    assert sorted(map(tuple, store.update_columns(a, part, "k").collect())) == [(1, "a"), (2, "z")]
    assert store.delete(a, part, "k").count() == 0


def test_forgotten_memories_stay_forgotten(spark):
    rows = [("1", "c", "Likes tea", 0.9, "active", 0), ("2", "c", "likes  TEA", 0.2, "forgotten", 1), ("3", "c", "x", None, "active", None), (None, "c", "y", 1.0, "active", 0), ("4", None, "z", 7.0, None, 0)]
    df = spark.createDataFrame(rows, "id string, category string, statement string, confidence double, status string, user_pinned int")
    got = sorted((r["ids"], r["status"], r["pinned"]) for r in store.merge_memories(df).collect())
    assert got == [(1, "active", 0), (1, "pending", 0), (2, "forgotten", 1)]


def test_read_around_and_windows(spark):
    m = spark.createDataFrame([("c", f"m{i}", i) for i in range(1, 8)] + [("c", None, 9), ("c", "x", None)], "conversation_id string, message_id string, sequence int")
    got = {(r["center"], r["message_id"]): r["offset"] for r in catalog.read_around(m, F.expr("sequence = 2"), 2, 1).collect()}
    assert got == {("m2", "m1"): -1, ("m2", "m2"): 0, ("m2", "m3"): 1}


def test_numeric_conflicts(spark):
    e = spark.createDataFrame([("a", "上限是 5 秒。其他"), ("b", "上限是 7 秒。"), ("c", "上限是 5 秒和 3 秒。"), ("d", None)], "source string, text string")
    got = [tuple(r) for r in evidence.numeric_conflicts(e).collect()]
    assert got == [("上限是 {value}", "秒", 2, 2)]


def test_selection_budget_partitions_candidates(spark):
    rows = [("q", "v1", "b", 0, 900, 0.9, 1), ("q", "v2", "b", 0, 300, 0.8, 2), ("q", "v3", "c", 0, 500, 0.7, 3), ("q", "v4", "d", 0, 50, 0.6, 4), ("q", "v5", "e", 0, 10, 0.1, 5), ("bad", "v6", "b", 0, 10, float("nan"), 1), ("bad", "v7", "b", 0, 10, 0.9, 2)]
    df = spark.createDataFrame(rows, "query_id string, view_id string, block_id string, start int, stop int, score double, rrf_rank int")
    got = {r["view_id"]: r["reason"] for r in evidence.select_budget(df, 0.5, chars=1000).collect()}
    assert got == {"v1": "selected", "v2": "contained", "v3": "over_budget", "v4": "selected", "v5": "below_threshold", "v6": "invalid_score", "v7": "invalid_score"}


def test_segments_join_to_the_text():
    text = "# A\n" + "word " * 60 + "\n\n- item " + "x" * 250 + "\n```\n# no heading\n" + "code\n" * 60 + "```\n| a | b |\n"
    spans = evidence.segments(text)
    assert "".join(text[s:e] for s, e in spans) == text and len(spans) >= 3 and all(e - s >= 200 for s, e in spans)
