import random
import re

from tessera.llm import split


def texts():
    r = random.Random(3)
    parts = ["word ", "句子。", "Sentence end. ", "\n", "\n\n", "## H\n", "，", "é", "x" * 40, "\U0001f469\u200d\U0001f4bb"]
    out = ["", "short", "x" * 1999, "x" * 2000, "x" * 2001, "x" * 9000, "a。" * 3000, "\U0001f469\u200d\U0001f4bb" * 2000]
    return out + ["".join(r.choice(parts) for _ in range(r.randint(200, 2500))) for _ in range(40)]


def test_pieces_are_bounded_overlapping_and_lossless():
    for t in texts():
        cores = split.bisect(t)
        assert "".join(t[s:e] for s, e, _ in cores) == t
        if len(t) <= split.LIMIT:
            assert len(cores) == 1
            continue
        for n, (s, e, _) in enumerate(cores):
            assert e - s <= split.LIMIT - split.OVERLAP
            assert n == 0 or s >= split.OVERLAP  # so the overlap is whole


def test_cuts_are_at_boundaries_where_there_are_any():
    t = ("Sentence number one. " * 60 + "\n\n") * 4
    assert all(strength >= 5 for *_, strength in split.bisect(t)[1:2])
    assert all(strength >= split.NATURAL for *_, strength in split.bisect(t)[1:])


def test_a_forced_cut_keeps_characters_whole():
    t = "\U0001f469\u200d\U0001f4bb" * 2000
    assert all(t[s] == "\U0001f469" for s, *_ in split.bisect(t))


def test_cut_kind():
    assert split.cut_kind("x" * 2000 + "\n" + "x" * 2000) == "natural"
    assert split.cut_kind("x" * 2001) == "forced" and split.cut_kind("") == "natural"
    assert bool(re.search(r"[^\n。！\uff1f.!?\uff1b;]{2001}", "y. " + "x" * 2002)) == (split.cut_kind("y. " + "x" * 2002) == "forced")


SCHEMA = "block_id string, doc_id string, text string, document_order int, chunk_type string, imported_at timestamp, start string"


def test_blocks_nulls_repeats_and_numbering(spark):
    long = "A sentence. " * 300
    rows = [("b1", "d", long, 0, "text", None, "x"), ("b1", "d", long, 0, "text", None, "y"), ("b2", "d", None, 1, None, None, None), ("b3", "d", "", None, "text", None, None), ("b4", "d", "c" * 2500, 2, "code", None, None), (None, None, "z", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = split.split_blocks(df).collect()
    own = sorted((r["document_order"], r["block_id"], r["piece"], r["pieces"]) for r in got if r["doc_id"] == "d")
    assert [o[0] for o in own] == list(range(len(own))) and [o[1] for o in own if o[1] != "b1"] == ["b2", "b4", "b4", "b3"]
    assert all(len(r["text"]) <= 2000 for r in got if r["text"]) and sum(r["block_id"] is None for r in got) == 1
    assert [tuple(r) for r in split.found(df).collect()] == [("b1", "natural")]
    docs = spark.createDataFrame([(1, "d"), (2, "none"), (3, None)], "doc_id long, content_hash string")
    counts = {r["doc_id"]: r["chunk_count"] for r in split.chunk_counts(docs, df).collect()}
    assert counts == {1: len(own), 2: 0, 3: 0}


def test_renumbering_spans_a_hot_document(spark):
    rows = [(f"b{i:05}", "hot", i if i % 3 else None, 1 + i % 2) for i in range(4000)]
    df = spark.createDataFrame(rows, "block_id string, doc_id string, document_order int, pieces int")
    got = split.renumber(df, span=100, spread=8).orderBy("first_order").collect()
    at = 0
    for r in got:
        assert r["first_order"] == at
        at += r["pieces"]
    orders = [r["document_order"] for r in got if r["document_order"] is not None]
    assert orders == sorted(orders) and all(r["document_order"] is None for r in got[len(orders) :])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert split.found(df).count() == 0 and split.split_blocks(df).count() == 0
