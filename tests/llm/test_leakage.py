import random

from tessera.llm import leakage as L
from tessera.llm.words import words

ITEMS = "id string, question string, evidence array<struct<doc:string,snippet:string>>, doc_id string"


def run_of(a, b):
    best = 0
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                cur[j + 1] = prev[j] + 1
                best = max(best, cur[j + 1])
        prev = cur
    return best


def test_against_brute_force(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [" ".join(r.choice(vocabulary) for _ in range(r.randint(10, 50))) for _ in range(20)]
    docs = []
    for i in range(120):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        p = r.choice(passages).split()
        n = r.randint(8, 25)
        s = r.randrange(max(1, len(p) - n))
        piece = p[s : s + n]
        w[len(w) // 2 : len(w) // 2] = [x.upper() + r.choice(["", ",", "\n", "**", " - "]) for x in piece]
        docs.append((i, " ".join(w), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (None, passages[0], "x"), (0, docs[0][1], "x"), (902, "z " * 30000 + passages[1], "x")]
    items = [(f"Q{i:02}", p, [], "x") for i, p in enumerate(passages[:10])] + [(f"Q{i:02}", None, [("d", p), ("d", None)], "x") for i, p in enumerate(passages[10:], 10)] + [("Q99", None, None, "x"), (None, passages[0], None, "x"), ("Q00", passages[0], [], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    q = spark.createDataFrame(items, ITEMS)
    want = {(i, f"Q{k:02}") for i, t, _ in docs if t for k, p in enumerate(passages) if run_of(words(t)[-200:], words(p)) >= 15}
    got = {tuple(x) for x in L.found(spark, d, q).collect()}
    assert got == want and len(want) > 20
    assert {tuple(x)[:3] for x in L.overlaps(spark, d, q, block_bytes=300).collect()} == {tuple(x)[:3] for x in L.overlaps(spark, d, q).collect()}


def test_replaced_words_are_tolerated(spark):
    p = [f"u{i}" for i in range(30)]
    t = p.copy()
    t[9], t[20] = "other", "else"
    d = spark.createDataFrame([(1, "start " + " ".join(t) + " end")], "doc_id long, text string")
    q = spark.createDataFrame([("Q", " ".join(p), [], "x")], ITEMS)
    r = L.overlaps(spark, d, q).collect()[0]
    assert (r["run"], r["words"], r["replaced"]) == (10, 30, 2)
    assert L.found(spark, d, q).count() == 0 and L.leaks(spark, d, q).collect()[0]["item_ids"] == ["Q"]


def test_short_passages_leak_as_a_whole(spark):
    """Passages of every length under MIN_RUN, beside a longer one of the same item that only nearly leaks."""
    sizes = (1, 3, 7, 8, 11, 12, 14)
    short = {n: [f"s{n}x{i}" for i in range(n)] for n in sizes}
    long = [f"l{i}" for i in range(40)]
    docs = [(n, " ".join(["start", *w, "mid", *long[:11], "end"])) for n, w in short.items()]
    docs += [(100 + n, " ".join(["start", *w[:-1], "end"])) for n, w in short.items() if n <= 12] + [(200, "s3x0 s3x1"), (201, "s3x2 end")]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame([(f"Q{n:02}", " ".join(w), [("d", " ".join(long))], "x") for n, w in short.items()], ITEMS)
    got = {(r["doc_id"], tuple(r["item_ids"]), r["longest"]) for r in L.leaks(spark, d, q).collect()}
    assert got == {(n, (f"Q{n:02}",), n) for n in sizes}
    assert L.found(spark, d, q).count() == 0


def test_a_longer_run_elsewhere_does_not_hide_a_leak(spark):
    p, o = [f"u{i}" for i in range(30)], [f"o{i}" for i in range(30)]
    t = p.copy()
    t[9], t[20] = "other", "else"
    d = spark.createDataFrame([(1, " ".join(["start", *t, "mid", *o[:11], "end"]))], "doc_id long, text string")
    r = L.leaks(spark, d, spark.createDataFrame([("Q", " ".join(p), [("d", " ".join(o))], "x")], ITEMS)).collect()
    assert [(x["item_ids"], x["longest"], x["longest_run"]) for x in r] == [(["Q"], 30, 10)]


def test_markup_between_words(spark):
    p = " ".join(f"v{i}" for i in range(16))
    text = p.replace(" v5 ", " <b>v5</b> ").replace(" v8 ", " [v8](http://x.example/y) ").replace(" v11 ", "&nbsp;v11\n\n> ")
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert L.found(spark, d, spark.createDataFrame([("Q", p, [], "x")], ITEMS)).count() == 1


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([], ITEMS)
    assert L.found(spark, d, q).count() == 0
    assert L.found(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), q).count() == 0


def test_every_mask_fits_the_required_run():
    assert all(len(m) <= L.MIN_RUN and m[0] == m[-1] == "1" for m in L.MASKS)
