from collections import Counter

import pytest

from tessera.llm import lookalikes as L

SPACED = "café abc 人 ・"


def classes(*texts):
    singles, pairs = Counter(), Counter()
    for t in [SPACED * 3, "the quick brown fox 0123456789 THE QUICK BROWN FOX fi fl ff", *texts]:
        singles.update(t)
        pairs.update(a + b for a, b in zip(t, t[1:], strict=False) if L.MARK.match(b))
    return L.Classes(dict(singles), dict(pairs))


@pytest.mark.parametrize(
    ("text", "want", "kinds"),
    [
        ("\uff21\uff22\uff43\uff11", "ABc1", {"fullwidth"}),
        ("cafe\u0301", "café", {"accent"}),
        ("re\u200bje\u2060cts\ufeff", "rejects", {"invisible"}),
        ("mi\u00adgration", "migration", {"invisible"}),
        ("a\u00a0b\u2007c\u202fd", "a b c d", {"space"}),
        ("\U0001d41b\U0001d428\U0001d425\U0001d41d \U0001d5cc\U0001d5ba\U0001d5c7\U0001d5cc \U0001d696\U0001d698\U0001d697\U0001d698", "bold sans mono", {"stylised"}),
        ("\ufb01lter \u2f00\u2f08 \u2ed3", "filter 一人 长", {"stylised"}),
        ("\u0440\u0430per", "paper", {"lookalike"}),
        ("jatm\u03bfndu\u0455_yord", "jatmondus_yord", {"lookalike"}),
        ("\u041c\u043e\u0441\u043a\u0432\u0430 \u0395\u03bb\u03bb\u03ac\u03b4\u03b1 \u03b1/\u03b2 \u03bc", "\u041c\u043e\u0441\u043a\u0432\u0430 \u0395\u03bb\u03bb\u03ac\u03b4\u03b1 \u03b1/\u03b2 \u03bc", set()),
        ("\U0001f469\u200d\U0001f4bb \u2764\ufe0f", "\U0001f469\u200d\U0001f4bb \u2764\ufe0f", set()),
        ("你好，世界！（好）\uff1a\uff1b", "你好，世界！（好）\uff1a\uff1b", set()),
        ("naïve Größe café", "naïve Größe café", set()),
        ("", "", set()),
    ],
)
def test_rewriting(text, want, kinds):
    assert classes(text).rewrite(text) == (want, kinds)


def test_rewriting_is_idempotent():
    t = "\uff34he \u0440\u0430per\u200b \U0001d41b cafe\u0301\u00a0x"
    c = classes(t)
    once, _ = c.rewrite(t)
    assert c.rewrite(once) == (once, set())


def test_classes_are_transitive_and_represented_by_frequency():
    c = classes("\uff45 \u0435 \U0001d41e")
    assert len({c.find(x) for x in ("e", "\uff45", "\u0435", "\U0001d41e")}) == 1
    d = L.Classes({"e": 1, "\u0301": 5, "é": 9}, {"e\u0301": 5})
    assert d.everywhere["e\u0301"] == "é"


def test_tables(spark):
    b = spark.createDataFrame([("b1", "plain", "A > \uff22", "x"), ("b1", "plain", "A > \uff22", "x"), ("b2", None, None, "x"), ("b3", "", "a\u00a0b", "x"), (None, "e\u200b", None, "x")], "block_id string, text string, heading_path string, kinds string")
    m = spark.createDataFrame([("m1", "\uff4d " * 10000, "x"), ("m2", "ok", "x")], "id string, statement string, value string")
    got = {tuple(r) for r in L.found(spark, b, m).collect()}
    assert got == {("blocks", "b1", "heading_path"), ("blocks", "b3", "heading_path"), ("blocks", None, "text"), ("memories", "m1", "statement")}
    whole = L.canonical(spark, L.values_of(b, m))
    assert whole.count() == 12 and whole.where("row_id = 'b2'").select("value").distinct().collect()[0][0] is None
    assert L.found(spark, b.limit(0), m.limit(0)).count() == 0
