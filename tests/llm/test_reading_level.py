import os

import numpy as np
import pytest

from tessera.llm import reading_level as R

LEVELS = {
    1: "My cat sees the red box. Her dog likes our old bike. The big key opens that door at home.",
    2: "The small shop sells the fresh bread and then each child takes one cake to the garden on Monday.",
    3: "We moved the search index to the new server, and the nightly job updates the cached rows after the weekly review.",
    4: "Theoretical classification methodologically presupposes the robustness of structural attribution, although justification complicates decomposition.",
    5: "Notwithstanding the epistemic underdetermination of normative provenance, dialectical institutionalisation recapitulates, insofar as phenomenological abstraction presupposes it, the contingency of ontological commitment.",
}


def corpus(spark, each=12):
    docs, labels = [], []
    for level, text in LEVELS.items():
        for i in range(each):
            key = level * 100 + i
            docs.append((key, f"# Title {i}\n\n" + " ".join([text] * (1 + i % 4)), "x"))
            if i < 6:
                labels += [(key, level, "r1", None), (key, level, "r1", None), (key, None if i % 2 else level, None, None)]
    quote = "“" + LEVELS[5] + "”"
    docs += [(901, "```\n" + LEVELS[5] + "\n```\n\n" + LEVELS[1] * 3 + " " + quote, "x"), (902, None, "x"), (903, "", "x"), (904, "中文" * 50, "x"), (905, "Der Hund und die Katze sind nicht im Haus, und das ist für den Mann ein Problem.", "x"), (906, "| a | b |\n|---|---|\n| 1 | 2 |", "x"), (101, docs[0][1], "x")]
    labels += [(None, 3, "r", None), (101, 9, "r", None)]
    return spark.createDataFrame(docs, "doc_id long, text string, theta string"), spark.createDataFrame(labels, "doc_id long, level int, rater string, rated_at timestamp")


def test_held_out_levels(spark):
    docs, labels = corpus(spark)
    rows = [(r["doc_id"], r["level"]) for r in R.levels(spark, docs, labels).collect()]
    got = dict(rows)
    assert set(got) == {level * 100 + i for level in LEVELS for i in range(12)} | {901}
    held = [(got[level * 100 + i] >= 4) == (level >= 4) for level in LEVELS for i in range(6, 12)]
    assert np.mean(held) == 1.0 and got[901] <= 2
    assert {r[0] for r in R.found(spark, docs, labels).collect()} == {k for k, v in got.items() if v >= 4}


def test_without_ratings_and_empty(spark):
    docs, labels = corpus(spark)
    theta = {r["doc_id"]: r["theta"] for r in R.levels(spark, docs, labels.limit(0)).collect()}
    assert np.mean([theta[500 + i] for i in range(12)]) > np.mean([theta[100 + i] for i in range(12)])
    assert R.found(spark, docs.limit(0), labels).count() == 0


def test_prose_only():
    text = "---\ntitle: x\n---\n# Head\nreal text here\n```\ncode\n```\n| t | u |\n> quoted\nitem: a；area: b；size: 3\n- listed sentence.\n12 13 14 15 16\n"
    assert R.prose(text) == ["real text here", "listed sentence."]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_accuracy_on_rated_documents(spark):
    """Levels come from a model that does not use a document's own rating for its own level's estimate."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "reading_labels"))
    table = R.counted(spark, docs, labels.where("doc_id % 2 = 0"))
    model = R.fit(spark, table)
    scored = R.score(spark, table, model)
    cut = R.cuts(scored)[2]
    held = R.ratings(labels.where("doc_id % 2 = 1"))
    rows = scored.drop("rating").join(held, scored["doc_id"] == held["rated_id"]).collect()
    assert np.mean([(r["theta"] >= cut) == (r["rating"] >= 3.5) for r in rows]) > 0.9


def test_every_document_has_a_row(spark):
    docs, labels = corpus(spark)
    more = [(1000 + i, t, "x") for i, t in enumerate(["猫在家。狗也在家。天很好。", "现象学的还原要求我们悬置自然态度，从而把意识的构成活动作为反思的对象，进而揭示意义的先验来源。", "Die Katze ist im Haus und das Kind ist nicht da.", "12 34"])]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = R.document_levels(spark, docs, labels).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: (r["lang"], r["level"]) for r in got}
    assert [by[k][0] for k in (1000, 1001, 1002, 1003, 902, 903, 906)] == ["zh", "zh", "xx", None, None, None, None]
    assert all((level is None) == (lang is None) for lang, level in by.values())
    english = {r["doc_id"]: r["level"] for r in R.levels(spark, docs, labels).collect()}
    assert {k: v[1] for k, v in by.items() if v[0] == "en"} == english


def test_evidence_grows_without_a_bound():
    model = R.Model()
    model.difficulty[100], model.slope = 1.0, np.linspace(-1, 1, len(R.GRID))
    at = [model.levels(np.array([0.9]), np.array([n / (1 + n / R.CLUSTER)]), np.zeros(1), np.array([R.PRIOR]))[0] for n in (50, 400, 4000, 40000)]
    assert at == sorted(at) and at[-1] > at[-2] > at[1]
