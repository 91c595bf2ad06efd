import os
import random

import pytest

from tessera.llm import packing as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no vocabulary files")


def brute(sizes, capacity, most):
    """The same rule with plain lists."""
    opened, fills, where = [], [], []
    for s in sizes:
        fit = [(capacity - fills[b] - s, n) for n, b in enumerate(opened) if fills[b] + s <= capacity]
        if fit:
            b = opened[min(fit)[1]]
        else:
            if len(opened) >= most:
                opened.remove(max(opened, key=lambda b: (fills[b], -opened.index(b))))
            b = len(fills)
            fills.append(0)
            opened.append(b)
        fills[b] += s
        opened.remove(b)  # a bin that changes goes behind those of equal space
        if fills[b] < capacity:
            opened.append(b)
        where.append(b)
    return where


def test_packer_against_plain_lists():
    r = random.Random(4)
    for capacity, most in ((50, 4), (200, 16), (64, 1)):
        sizes = [r.randint(1, capacity) for _ in range(800)]
        packer = P.Packer(capacity, most)
        assert [packer.add(s) for s in sizes] == brute(sizes, capacity, most)
        assert packer.open <= most
        fills = dict(packer.closed) | dict(packer.still_open())
        assert sum(fills.values()) == sum(sizes) and max(fills.values()) <= capacity


def test_documents(spark):
    r = random.Random(6)
    texts = ["word " * r.randint(1, 90) for _ in range(300)] + ["", None, "long " * 1000, "long " * 1000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, part int").repartition(3)
    got = P.pack(spark, df, capacity=128, most_open=8).collect()
    count = P.token_counter(P.TOKENIZER)
    by_doc, by_bin = {}, {}
    for x in got:
        by_doc.setdefault(x["doc_id"], []).append(x)
        if x["container"] is not None:
            by_bin[x["container"]] = by_bin.get(x["container"], 0) + x["tokens"]
    for i, t in enumerate(texts):
        size = count(t) if t else 0
        assert sum(x["tokens"] for x in by_doc[i]) == size
        assert len(by_doc[i]) == max(1, -(-size // 128))
        assert (by_doc[i][0]["container"] is None) == (size == 0)
    assert max(by_bin.values()) <= 128
    used = sum(by_bin.values()) / (128 * len(by_bin))
    assert used > 0.93
    assert P.pack(spark, df.limit(0)).count() == 0
