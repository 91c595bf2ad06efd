import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import near_duplicates as N
from tessera.llm.words import hashes_of_texts, words


def brute(rows):
    sets = {(t, i, frozenset(zip(w, w[1:], w[2:], strict=False))) for t, i, x in rows if i is not None and x for w in [words(x)]}
    sets = [s for s in sets if s[2]]
    out = set()
    for (ta, a, x), (tb, b, y) in itertools.combinations(sets, 2):
        if ta == tb and a != b and 2 * len(x & y) >= len(x | y):
            out.add((ta, min(a, b), max(a, b)))
    return out


def corpus(seed, n, long=60):
    """Records from few phrases, so that tokens are frequent, with edited copies."""
    r = random.Random(seed)
    phrases = [" ".join(f"w{r.randint(0, 60)}" for _ in range(r.randint(3, 8))) for _ in range(60)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            w = r.choice(rows)[2].split()
            for _ in range(r.randint(0, max(1, len(w) // 8))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [w[k], "new"], [f"w{r.randint(0, 90)}"]])
            text = " ".join(w) or "a b c"
        else:
            text = " ".join(r.choice(phrases) for _ in range(r.randint(1, r.choice([3, 10, long]))))
        rows.append((r.choice(["blocks", "image_descriptions"]), f"id{i:04}", text))
    return rows


@pytest.mark.parametrize(("seed", "n", "long"), [(1, 150, 60), (2, 250, 120)])
def test_against_brute_force(spark, seed, n, long):
    rows = corpus(seed, n, long)
    rows += [("blocks", "short", "a b"), ("blocks", "null", None), ("blocks", None, rows[0][2]), ("blocks", "empty", ""), ("blocks", rows[0][1], rows[0][2]), ("blocks", "three", "x y z"), ("blocks", "three2", "X, y; z!"), ("blocks", "中一", "中文字"), ("blocks", "中二", "中 文 字")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "tbl string, id string, text string, h string").repartition(5)
    got = {tuple(r) for r in N.found(spark, df).collect()}
    want = brute(rows)
    assert got == want and len(want) > 20


def test_tiers_against_brute_force_on_signatures():
    """Any two similar records share a signature whose smaller side is inner, at every size and class structure."""
    r = np.random.default_rng(7)
    universe = np.unique(r.integers(1, 1 << 43, 3000).astype(np.uint64))
    for size in (4, 9, 30, 33, 40, 66, 70, 120, 300, 560):
        base = r.choice(len(universe), size, replace=False)
        sets = [np.sort(base)]
        for share in (0.5, 0.55, 0.7, 0.9):
            keep = base[: int(np.ceil(size * share))]
            extra = r.choice(np.setdiff1d(np.arange(len(universe)), base), int(r.integers(0, size)), replace=False)
            sets.append(np.sort(np.concatenate([keep, extra[: max(0, 2 * len(keep) - size)]])))
        sets += [np.sort(r.choice(len(universe), int(s), replace=False)) for s in r.integers(max(3, size // 2), 2 * size + 1, 8)]
        df = np.bincount(np.concatenate(sets), minlength=len(universe))
        df[r.choice(len(universe), 1500, replace=False)] += 50  # frequent tokens: pair classes
        sizes = np.array([len(s) for s in sets], np.int32)
        sig, rec, inner = N.signatures(universe, N.frequency_code(np.maximum(df, 1)), np.concatenate(sets).astype(np.uint32), sizes)
        by = {}
        for s, d, i in zip(sig.tolist(), rec.tolist(), inner.tolist(), strict=True):
            by.setdefault(s, []).append((d, i))
        met = set()
        for own in by.values():
            for (a, ia), (b, ib) in itertools.combinations(own, 2):
                na, nb = sizes[a], sizes[b]
                if (ia and ib) if na == nb else ia if na < nb else ib:
                    met.add((min(a, b), max(a, b)))
        for a, b in itertools.combinations(range(len(sets)), 2):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if x != y and 2 * len(x & y) >= len(x | y):
                assert (a, b) in met, (size, a, b)


def test_bitmap_bound_never_drops_a_similar_pair():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(200):
        base = r.integers(1, 1 << 43, int(r.integers(3, 300))).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: int(len(base) * 0.8)], r.integers(1, 1 << 43, len(base) // 5).astype(np.uint64)]))]
    sizes = np.array([len(s) for s in sets], np.int32)
    maps, offsets, widths = N.bitmaps(np.concatenate(sets), sizes)
    a, b = np.triu_indices(len(sets), 1)
    near = 2 * np.minimum(sizes[a], sizes[b]) >= np.maximum(sizes[a], sizes[b])  # others are never asked about
    a, b = a[near], b[near]
    ok = N.passing(a, b, sizes, maps, offsets, widths)
    for i, j, good in zip(a, b, ok, strict=True):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 2 * both >= len(sets[i]) + len(sets[j]) - both:
            assert good
    assert ok.mean() < 0.05


def test_large_classes_of_copies_are_stars(spark):
    n = N.EXPAND + 5
    rows = [("blocks", f"c{i:03}", "one two three four five six") for i in range(n)] + [("blocks", "near", "one two three four five seven")]
    got = {tuple(r) for r in N.found(spark, spark.createDataFrame(rows, "tbl string, id string, text string")).collect()}
    assert got == {("blocks", "c000", f"c{i:03}") for i in range(1, n)} | {("blocks", "c000", "near")}


def test_different_texts_of_a_large_class_are_all_paired(spark):
    """Equal sets, different texts: only exact copies may be a star, within the class and in links to others."""
    n = N.EXPAND + 5
    rows = [("blocks", f"c{i:03}", "one two three four five six") for i in range(n)]
    rows += [("blocks", f"d{i}", "One two, three four five six!") for i in range(3)] + [("blocks", "a", "**one** two three\nfour five six"), ("blocks", "c001", "one two three four five SIX")]
    rows += [("blocks", "near1", "one two three four five seven"), ("blocks", "near2", "one two three, four five seven")]
    got = {tuple(r) for r in N.found(spark, spark.createDataFrame(rows, "tbl string, id string, text string")).collect()}
    stand = ["c000", "c001", "a", "d0", "d1", "d2", "near1", "near2"]  # c001 also has a text of its own
    assert got == {("blocks", "c000", f"c{i:03}") for i in range(1, n)} | {("blocks", *sorted(p)) for p in itertools.combinations(stand, 2)}


def test_large_class_of_different_texts_against_brute_force(spark):
    rows = [("blocks", f"v{i:02}", "one two three four five six" + "!" * i) for i in range(N.EXPAND + 8)] + [("blocks", "near", "one two three four five seven")]
    got = {tuple(r) for r in N.found(spark, spark.createDataFrame(rows, "tbl string, id string, text string")).collect()}
    assert got == brute(rows)


def test_groups(spark):
    rows = [("blocks", "a", "1 2 3 4 5 6 7 8"), ("blocks", "b", "1 2 3 4 5 6 7 9"), ("blocks", "c", "1 2 3 4 5 6 7 9"), ("blocks", "d", "0 0 2 3 4 5 6 7 9"), ("blocks", "e", "other words here"), ("image_descriptions", "a", "1 2 3 4 5 6 7 8")]
    got = {(r["tbl"], r["id"]): (r["group_id"], r["links"]) for r in N.groups(spark, spark.createDataFrame(rows, "tbl string, id string, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {("blocks", "a"): "a", ("blocks", "b"): "a", ("blocks", "c"): "a", ("blocks", "d"): "a", ("blocks", "e"): "e", ("image_descriptions", "a"): "a"}
    assert got["blocks", "e"][1] == 0 and got["blocks", "b"][1] == got["blocks", "c"][1] >= 1


def test_empty(spark):
    df = spark.createDataFrame([], "tbl string, id string, text string")
    assert N.found(spark, df).count() == 0 and N.groups(spark, df).count() == 0


def test_encodings():
    r = np.random.default_rng(1)
    a = np.sort(r.integers(0, 1 << 60, 1000).astype(np.uint64))
    assert (N.stretch_sorted(N.squeeze_sorted(a)) == a).all() and len(N.stretch_sorted(N.squeeze_sorted(a[:0]))) == 0
    p = r.integers(0, 1 << 31, 1000).astype(np.uint32)
    assert (N.stretch_places(N.squeeze_places(p)) == p).all()


def test_copies_in_many_batches_are_one_record(spark):
    """A set that every task holds is kept by one batch only; its links and members stay whole."""
    text = " ".join(f"w{i}" for i in range(42))
    rows = [("blocks", f"c{i:03}", text) for i in range(120)] + [("blocks", "near", text + " w42"), ("blocks", "far", "a b c d e f")]
    df = spark.createDataFrame(rows, "tbl string, id string, text string").repartition(40)
    stored = N.bucketed(spark, N.batches(df), "batch")
    packed = stored.where("total IS NOT NULL")
    gone = N.repeated(spark, packed).collect()
    sets = [h for r in packed.select("sets").collect() for h in N.stretch(r[0], np.uint64).tolist()]
    assert sum(len(r["gone"]) for r in gone) == len(sets) - len(set(sets)) > 20 and len(set(sets)) == 3
    members, links = N.classes(spark, df)
    got = {r["id"]: (r["class_id"], r["size"], r["links"]) for r in members.collect()}
    assert got == {f"c{i:03}": ("c000", 120, 1) for i in range(120)} | {"near": ("near", 1, 1), "far": ("far", 1, 0)}
    assert [tuple(r)[:3] for r in links.collect()] == [("blocks", "c000", "near")]


def test_blocks_of_hot_signatures_lose_no_pair():
    """Every inner record meets every record of its signature in a block where one of the two owns the pair."""
    r = np.random.default_rng(5)
    n = 200
    sig, rec, inner = np.full(n, 7, np.uint64), np.arange(n), r.random(n) < 0.5
    code = np.full(n, N.frequency_code(np.array([N.HOT * 5]))[0])
    assert int(N.blocks_of_code(code)[0]) >= 5
    s, d, k = N.in_blocks(sig, rec, inner, code, r.integers(1, 1 << 60, n).astype(np.uint64))
    blocks = {}
    for a, b, c in zip(s.tolist(), d.tolist(), k.tolist(), strict=True):
        blocks.setdefault(a, []).append((b, c))
    met = {frozenset((a, b)) for own in blocks.values() for (a, x), (b, y) in itertools.permutations(own, 2) if x == 0}
    assert met == {frozenset((a, b)) for a, b in itertools.combinations(range(n), 2) if inner[a] or inner[b]}
    cold = N.in_blocks(sig, rec, inner, np.full(n, 3, np.uint8), np.arange(n).astype(np.uint64))
    assert (cold[0] == sig).all() and (cold[2] == np.where(inner, 0, 2)).all()


def test_classes_hold_what_stars_leave_out(spark):
    """Members and links together give every pair of the brute force."""
    rows = corpus(9, 120, 20) + [("blocks", f"z{i}", "one two three four five six") for i in range(N.EXPAND + 3)] + [("blocks", "zz", "one two three four five seven"), ("blocks", None, "x y z"), ("blocks", "short", "a")]
    members, links = N.classes(spark, spark.createDataFrame(rows, "tbl string, id string, text string").repartition(6))
    of = {}
    for m in members.collect():
        of.setdefault((m["tbl"], m["class_id"]), set()).add(m["id"])
    got = {(t, *p) for (t, _), ids in of.items() for p in itertools.combinations(sorted(ids), 2)}
    for x in links.collect():
        got |= {(x["tbl"], *sorted((a, b))) for a in of[x["tbl"], x["class_a"]] for b in of[x["tbl"], x["class_b"]]}
    assert got == brute(rows)


def test_hashes_of_texts_are_those_of_their_words():
    texts = ["Über_all die ＡＢＣ 中文字a1 x", "", "a  a", "İstanbul ﬁn e\u0301te", "中 中", "𠀀x𠀀", "___", "über ÜBER", "\ud800a"]
    hashes, sizes = hashes_of_texts(texts)
    assert sizes.tolist() == [len(words(t)) for t in texts]
    every = [w for t in texts for w in words(t)]
    by = {}
    for w, h in zip(every, hashes.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    rows = [("t", str(i), t) for i, t in enumerate(texts * 3)]
    frame = pd.DataFrame(rows, columns=["tbl", "id", "text"])
    own = [[(i, h, x.tolist()) for _, i, h, _, x in N.sets_of_frame(frame, {}, 2, n)] for n in (5, 1_000_000)]
    assert own[0] == own[1] and len(own[0]) == 3 * sum(len(words(t)) > 1 for t in texts)


def test_more_hash_ranges_do_not_multiply_what_is_sent(spark):
    """A record's bitmap is stored once; what goes to the ranges is bounded by its signatures, whatever their number."""
    r = random.Random(4)
    texts = []
    for _ in range(1500):  # frequent runs, as in a large corpus
        texts.append(" ".join(f"a{k} b{k} c{k} d{k}" for k in r.sample(range(40), 30)))
    df = spark.createDataFrame([("blocks", f"i{i:04}", t) for i, t in enumerate(texts)], "tbl string, id string, text string").coalesce(1)
    packed = N.bucketed(spark, N.batches(df), "batch").where("total IS NOT NULL").withColumn("gone", F.lit(None).cast("array<long>"))

    def sent(ranges):
        keys = N.range_keys(spark, ranges)
        told = packed.join(N.frequencies(packed, keys), F.col("batch") == F.col("b"))
        rows = N.send_signatures(told, keys)
        return rows.select(sum(F.length(c) for c, kind in rows.dtypes if kind == "binary").alias("n")).agg(F.sum("n")).first()[0]

    assert sent(60) < 1.5 * sent(6)


@pytest.mark.parametrize("files", [1, 3])
def test_many_hash_ranges_and_files_of_bitmaps_against_brute_force(spark, monkeypatch, files):
    monkeypatch.setattr(N, "LEAST_RANGES", 40)
    monkeypatch.setattr(N, "BATCH_DOCS", 7)
    monkeypatch.setattr(N, "MAP_TOKENS", 1 if files > 1 else N.MAP_TOKENS)
    stored = N.stored_bitmaps
    monkeypatch.setattr(N, "stored_bitmaps", lambda s, own, n: stored(s, own, min(n, files)))
    rows = corpus(11, 120, 40)
    rows += [(t, f"again{i}", x) for i, (t, _, x) in enumerate(rows[:20])]
    got = {tuple(r) for r in N.found(spark, spark.createDataFrame(rows, "tbl string, id string, text string").repartition(4)).collect()}
    assert got == brute(rows) and len(got) > 20


def test_memberships_of_a_task_are_in_one_bucket(spark):
    """Else every task writes a file for each bucket, and their number grows with the square of the input."""
    df = spark.createDataFrame([("blocks", f"i{i}", f"one two three w{i}") for i in range(200)], "tbl string, id string, text string").coalesce(1)
    assert N.batches(df).where("total IS NULL").select("batch").distinct().count() == 1
