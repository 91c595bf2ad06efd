"""Hand cases of the operators that SQL covers in part or not at all, and their defined results for odd input."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import queries as Q
from tessera.functions import scalars as X
from tessera.operators import containment, dense, entries, history, hybrid, ingest, memory, quality, research, rerank
from tessera.sources import files
from tessera.streaming import event_log

CASES = [
    ("请问分表的方案是什么样的？", "分表方案"), ("我好像记得京东的对比详情是什么样的", "京东对比详情"), ("这些对比的具体详情是什么样的", "详情"), ("关于缓存以及它的机制", "缓存 机制"), ("团队是如何实现缓存的", "实现缓存"), ("我们怎么配置网关？", "配置网关"),
    ("99分位在业务场景中有什么作用", "99分位"), ("p99.90 的意义是什么呢", "99.9分位"), ("99分位和95分位的区别", "99分位和95分位区别"), ("A ， B ？？", "A,B"), ("keep this", "keep this"), ("请问", "请问"), ("", ""), (None, ""),
]


@pytest.mark.parametrize(("question", "want"), CASES)
def test_plain_form_by_cases(question, want):
    assert Q.plain_question(question) == want


def test_variants_have_the_name_of_a_definition(spark):
    q = spark.createDataFrame([("1", "请问什么是 ADB？"), ("2", "什么是ADB")], "id string, question string")
    got = [(r["id"], r["kind"], r["text"]) for r in Q.variants(q, "id", "question").orderBy("id", "ord").collect()]
    assert ("1", "definition_subject", "ADB") in got and got[0][:2] == ("1", "original")


def one(spark, f, *values, schema=None):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema or "a string")
    return [r[0] for r in df.select(f(*[F.col(c) for c in df.columns])).collect()]


def test_json_of_models(spark):
    got = one(spark, X.json_in, 'Sure:\n```json\n{"a": 1}\n``` done', 'x [1, 2] y', "no json", '{"a": ', None)
    assert got == ['{"a": 1}', "[1, 2]", None, None, None]


def test_support_rules(spark):
    rows = [("缓存 gateway 限流", "网关 gateway 的缓存限流"), ("有没有备份策略", "我们讨论缓存策略"), ("有没有备份策略", "备份策略在这里"), ("x", None), ("", "text")]
    assert one(spark, X.supports, *rows, schema="a string, b string") == [True, False, True, False, False]
    rel = [("alpha beta", "alpha", None), ("alpha beta", "alpha beta", None), ("alpha", "none", 0.9), ("alpha", "alpha", 0.1), ("", "a", None)]
    assert one(spark, X.lexically_relevant, *rel, schema="a string, b string, c double") == [False, True, True, False, False]


def test_gaps_numbers_and_titles(spark):
    gaps = [("资料不足，没有找到备份周期的说明", "备份周期"), ("备份周期是七天", "备份周期"), ("Not found: the ADB quota", "ADB limits"), (None, "x")]
    assert one(spark, X.gap_disclosed, *gaps, schema="a string, b string") == [True, False, True, False]
    nums = [("3.14", "3.1"), ("0.25", "25"), ("100", "101"), ("2.00", "2.01"), ("x", "1")]
    assert one(spark, X.numbers_equal, *nums, schema="a string, b string") == [True, True, False, True, False]
    assert one(spark, X.document_title, "---\ntitle: \"T\"\n---\n# H", "text\n# Head #\n", "## no", None) == ["T", "Head", None, None]
    assert one(spark, X.front_matter, "---\na: 1\nb: x: y\na: 2\n# c\n---\nt", "none") == [{"a": "1", "b": "x: y"}, {}]
    assert one(spark, X.informative_heading, "A > https://x.example/a", "A > Limit: 5", "A > B", "") == ["https://x.example/a", "Limit: 5", None, None]


def test_pictures_and_context(spark):
    text = "# Scene\nA cat.\n# Context\nfrom chat\n# Text\n\n# Scene\nA cat.\n"
    assert one(spark, X.image_facts, text, "plain", None) == ["# Scene\nA cat.", "plain", ""]
    assert one(spark, lambda c: X.compact_context(c, 12), "One  two\n\none two\n\nthree four", "") == ["One two\nthre", ""]
    assert one(spark, lambda c: X.focused_offset(c, F.array(F.lit("alpha"), F.lit("beta")), 20), "alpha" + "x" * 100 + "alpha beta", "none", "") == [95, 0, 0]


def test_relative_ranges(spark):
    df = spark.createDataFrame([("today",), ("last 7 days",), ("never",)], "w string").withColumn("now", F.lit("2024-03-01 18:30:00").cast("timestamp"))
    got = df.select(X.resolved_range(F.col("w"), F.col("now"), "Asia/Shanghai").alias("r")).select("r.*").collect()
    assert [(str(r["start"]), str(r["end"])) for r in got] == [("2024-03-02", "2024-03-02"), ("2024-02-25", "2024-03-02"), ("None", "None")]


def test_containment_against_brute_force(spark):
    needles = ["a", "ab", "abcde", "中文", "文", "", None, "zz"]
    hay = ["xabcdex", "中文字", "a", "", None, "ab ab"]
    n = spark.createDataFrame(list(enumerate(needles)), "nid int, needle string")
    h = spark.createDataFrame(list(enumerate(hay)), "hid int, text string")
    got = {tuple(r) for r in containment.containing(n, h).collect()}
    assert got == {(i, j) for i, a in enumerate(needles) for j, b in enumerate(hay) if a and b and a in b}


def test_scope_rules(spark):
    t = spark.createDataFrame([(1, "缓存系统设计手册"), (2, "备份策略"), (3, "备份策略"), (4, "Guide")], "doc_id int, title string")
    q = spark.createDataFrame([("a", "the guide says?"), ("b", "备份策略是什么"), ("c", "缓存系统设计怎么写"), ("d", "“缓存系统” 在哪"), ("e", ""), ("f", None)], "query_id string, question string")
    assert {r["query_id"]: r["doc_id"] for r in entries.resolve_scope(q, t).collect()} == {"a": 4, "c": 1, "d": 1}


def test_standing_against_brute_force(spark):
    r = random.Random(8)
    needles = ["".join(r.choice("ab中") for _ in range(r.randint(1, 9))) for _ in range(60)] + ["", None, "𠀀b", "abab"]
    texts = ["".join(r.choice("ab中𠀀") for _ in range(r.randint(0, 14))) for _ in range(80)] + [None]
    n, h = spark.createDataFrame([(x,) for x in needles * 2], "needle string"), spark.createDataFrame([(x,) for x in texts * 2], "text string")
    got = [tuple(x) for x in containment.standing(n, h).collect()]
    want = {(a, b) for a in needles for b in texts if a and b and a in b}
    assert set(got) == want and len(got) == len(want) > 100
    assert containment.standing(n.where("needle = ''"), h).count() == 0


def test_titles_that_begin_alike_are_not_paired_with_all_questions(spark, monkeypatch):
    """Rows of a join follow the questions, not their number times that of the titles with the same beginning."""
    n = 3000
    titles = spark.createDataFrame([(i, f"reading-plan-{i:05}") for i in range(n)] + [(n, "reading-plan-00007")], "doc_id int, title string")
    asked = titles.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("what does "), "title", F.lit(" say?")).alias("question"))
    frames = []
    monkeypatch.setattr(entries, "standing", lambda a, b: frames.append(containment.standing(a, b)) or frames[-1])
    got = {x["query_id"]: x["doc_id"] for x in entries.resolve_scope(asked, titles).collect()}
    assert got == {i: i for i in range(n) if i != 7}
    assert frames[0].count() == n
    frames[0].collect()
    plan = frames[0]._jdf.queryExecution().executedPlan()

    def rows(p):
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return rows(p.executedPlan())
        if "QueryStage" in name:
            return rows(p.plan())
        m = p.metrics().get("numOutputRows")
        own = m.get().value() if "Join" in name and m.isDefined() else 0
        kids = p.children()
        return max([own, *(rows(kids.apply(i)) for i in range(kids.size()))])

    assert 0 < rows(plan) <= 40 * n


def test_scope_of_repeated_rows_and_missing_ids(spark):
    t = spark.createDataFrame([(1, "Alpha guide"), (1, "Alpha"), (2, "Beta"), (None, "Gamma"), (3, "Gamma ray"), (4, "one “Alpha part”"), (5, "x 缓存系统设计手册")], "doc_id int, title string")
    q = spark.createDataFrame([("a", "the alpha guide?"), ("a", "alpha again"), ("b", "beta and alpha"), ("c", "gamma ray?"), ("d", "gamma?"), ("e", "“ha part” 缓存系统设计"), (None, "beta")], "query_id string, question string")
    assert {r["query_id"]: r["doc_id"] for r in entries.resolve_scope(q, t).collect()} == {"a": 1, "c": 3, "e": 4, None: 2}


def test_checked_query_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0])], "id string, v array<double>")
    assert dense.checked(df.where("id = 'a'"), "v", 2).count() == 1
    with pytest.raises(Exception, match="not usable"):
        dense.checked(df, "v", 2).collect()
    with pytest.raises(Exception, match="not usable"):
        dense.checked(df.where("id = 'a'"), "v", 3).collect()


def gated(spark, rows):
    cols = "query_id string, block_id string, rrf_rank int, rrf_score double, dense_similarity double, lexical_rank int, rescue boolean, informative_coverage double, informative_matched_terms int, identifier_matched_terms int, reason string, text string"
    return spark.createDataFrame(rows, cols)


def test_anchors_reserve_places_and_prefer_definitions(spark):
    b = spark.createDataFrame([("a", "H1", "f.md", "text"), ("b", "H1", "f.md", "text"), ("c", "H2", "g.md", "text"), ("d", "H3", "h.md", "image_description"), ("e", "H3", "h.md", "text"), ("r", "H4", "i.md", "text")], "block_id string, heading_path string, source_file string, chunk_type string")
    rows = [("q", "a", 1, 0.05, 0.9, None, False, None, None, None, "accepted_dense_only", "a"), ("q", "b", 2, 0.04, 0.85, None, False, None, None, None, "accepted_dense_only", "b"), ("q", "c", 3, 0.03, 0.8, 2, True, 0.9, 3, 1, "accepted_lexical_rescue", "c"), ("q", "d", 4, 0.02, 0.7, None, False, None, None, None, "accepted_dense_only", "d"), ("q", "e", 5, 0.021, 0.75, None, False, None, None, None, "accepted_dense_only", "e"), ("q", "r", 6, 0.01, 0.1, None, False, None, None, None, "rejected_dense_below_threshold", "r")]
    q = spark.createDataFrame([("q", "plain words")], "query_id string, question string")
    got = [(r["block_id"], r["reserve"]) for r in hybrid.anchors(gated(spark, rows), b, q).orderBy("place").collect()]
    assert got == [("c", "lexical"), ("a", "dense"), ("e", "dense"), ("b", "none"), ("d", "none")]
    named = [(*r[:-1], "ADB 是一种数据库" if r[1] == "b" else r[-1]) for r in rows]
    q = spark.createDataFrame([("q", "什么是 ADB")], "query_id string, question string")
    assert hybrid.anchors(gated(spark, named), b, q).orderBy("place").first()["block_id"] == "b"


def test_hybrid_of_empty_tables(spark):
    b = spark.createDataFrame([], "block_id string, doc_id string, text string, heading_path string, source_file string, chunk_type string, similarity double, source_type string")
    q = spark.createDataFrame([("q", "alpha"), ("e", ""), ("n", None)], "query_id string, question string")
    context, trace = hybrid.retrieve(spark, b, q)
    assert context.count() == 0 and trace.count() == 0
    full = spark.createDataFrame([("b1", "d1", "alpha beta", "H", "f.md", "text", None, "document"), ("b2", "d2", "gamma", "H", "g.md", "text", None, "document"), ("b3", "d3", None, None, None, None, None, None)], b.schema)
    context, trace = hybrid.retrieve(spark, full, q)
    assert {r["block_id"] for r in context.collect()} <= {"b1"} and {r["query_id"] for r in trace.collect()} <= {"q"}
    with pytest.raises(ValueError, match="1 documents"):
        hybrid.scope_of(full, spark.createDataFrame([("d1",), ("zz",)], "doc_id string"))


def test_rerank_contracts(spark):
    h = "0" * 64
    cols = "query_id string, candidate_id string, scope_id string, index_revision string, ranking_text string, payload_hash string"
    rows = [("ok", "a", "s", "r", "t", h), ("twice", "a", "s", "r", "t", h), ("twice", "a", "s", "r", "t", h), ("scope", "a", "x", "r", "t", h), ("old", "a", "s", "x", "t", h), ("blank", "a", "s", "r", " ", h), ("hash", "a", "s", "r", "t", "zz"), ("null", "a", None, "r", "t", h)]
    s = spark.createDataFrame([(q, "s", "r") for q in ("ok", "twice", "scope", "old", "blank", "hash", "null", "none")], "query_id string, scope_id string, index_revision string")
    got = {r["query_id"]: r["status"] for r in rerank.checked(spark.createDataFrame(rows, cols), s).collect()}
    assert got == {"ok": "ok", "twice": "duplicate_id", "scope": "scope_mismatch", "old": "version_changed", "blank": "incomplete", "hash": "incomplete", "null": "scope_mismatch", "none": "empty"}
    req = spark.createDataFrame([(q, c, "t", "w") for q in ("ok", "miss", "more", "twice", "nan") for c in "ab"], "query_id string, candidate_id string, ranking_text string, question string")
    ans = [("ok", "a", 0.1), ("ok", "b", 1.0), ("miss", "a", 0.1), ("more", "a", 0.1), ("more", "b", 0.1), ("more", "c", 0.1), ("twice", "a", 0.1), ("twice", "a", 0.1), ("twice", "b", 0.1), ("nan", "a", math.nan), ("nan", "b", 0.1)]
    a = spark.createDataFrame(ans, "query_id string, candidate_id string, score double")
    assert {r["query_id"]: r["status"] for r in rerank.answered(req, a).collect()} == {"ok": "ok", "miss": "missing", "more": "foreign", "twice": "repeated", "nan": "out_of_range"}
    fails = rerank.scored_by(req, lambda question, texts: [0.5] * (len(texts) - 1))
    assert {r["status"] for r in rerank.answered(req, fails).collect()} == {"out_of_range"}
    good = rerank.scored_by(req, lambda question, texts: [0.5] * len(texts))
    assert {r["status"] for r in rerank.answered(req, good).collect()} == {"ok"}


def test_quality_of_cases(spark):
    views = spark.createDataFrame([("q", "a", 1, True, 10), ("q", "b", 2, True, 30), ("q", "c", 9, False, 5), ("n", "a", 1, True, 4), ("u", "z", 1, True, 4)], "query_id string, key string, rank int, returned boolean, chars int")
    grades = spark.createDataFrame([("q", "a", 1, 3, "g1"), ("q", "a", 0, 2, None), ("q", "b", 1, 1, None), ("q", "c", 1, 3, "g2"), ("n", "a", 1, 0, None)], "query_id string, key string, ord int, grade int, grp string")
    hard = spark.createDataFrame([("q", "b"), ("q", "b")], "query_id string, key string")
    cases = spark.createDataFrame([("q", True, 2, "f"), ("n", False, 0, "f"), ("u", True, 1, "g"), ("x", False, 0, "g")], "query_id string, needs_answer boolean, groups int, family string")
    m = {r["query_id"]: r for r in quality.by_case(views, grades, hard, cases).collect()}
    assert (m["q"]["precision"], m["q"]["recall"], m["q"]["coverage"], m["q"]["hard_returned"]) == (0.5, 0.5, 1.0, 1)
    assert m["u"]["precision"] is None and m["u"]["unjudged"] == 1 and m["n"]["empty_false"] and not m["x"]["empty_false"] and m["x"]["returned"] == 0
    r = quality.report(quality.by_case(views, grades, hard, cases), "family")
    whole = r.where("level = 'all'").first()
    assert whole["cases"] == 4 and whole["precision_macro"] == 0.25 and whole["irrelevant_char_ratio"] == round(34 / 44, 6) and whole["unjudged"] == 1
    failed = {x["value"]: x["failed"] for x in quality.gate(r, "family").collect()}
    assert set(failed[""].split("+")) == {"unjudged", "precision", "recall", "hard_negatives", "empty_false_context"}
    assert quality.report(quality.by_case(views.limit(0), grades.limit(0), hard.limit(0), cases.limit(0)), "family").count() <= 1


def test_private_cases(spark):
    pub = spark.createDataFrame([("1", "q")], "id string, question string")
    h = pub.select(F.sha2(F.to_json(F.struct("question")), 256)).first()[0]
    assert quality.merge_private(pub, spark.createDataFrame([("1", h, "secret")], "id string, content_hash string, answer string"), "id", ["question"]).first()["answer"] == "secret"
    with pytest.raises(ValueError, match="1 private"):
        quality.merge_private(pub, spark.createDataFrame([("1", "old", "x")], "id string, content_hash string, answer string"), "id", ["question"])


T0 = dt.datetime(2024, 1, 1)


def test_history_cuts_and_forks(spark):
    m = spark.createDataFrame([("m1", "c", "user", "a", T0, 1), ("m2", "c", "ai", "b", T0, 2), ("m3", "d", "user", None, None, None), (None, "d", "user", "x", T0, 1)], "message_id string, conversation_id string, role string, content string, created_at timestamp, sequence int")
    kept, runs = history.truncate(m, spark.createDataFrame([("c", 2)], "conversation_id string, cut int"), spark.createDataFrame([("r", "m2"), ("s", "m1"), ("t", None)], "run string, message_id string"))
    assert {r["message_id"] for r in kept.collect()} == {"m1", "m3", None} and {r["run"]: r["message_id"] for r in runs.collect()} == {"r": None, "s": "m1", "t": None}
    assert history.fork(m, "c", "n", 2).where("conversation_id = 'n'").count() == 1
    q = spark.createDataFrame([("q", "zz"), ("e", "！")], "query_id string, question string")
    assert history.search(m, q).count() == 0 and history.search(m.limit(0), q).count() == 0
    assert {r["conversation_id"]: r["title"] for r in history.summaries(m).collect()} == {"c": "a", "d": None}


def test_memory_life_cycle(spark):
    now = spark.createDataFrame([("k", "a", "active", True, 1), ("f", "b", "forgotten", True, 4)], "key string, statement string, status string, enabled boolean, revision long")
    ops = spark.createDataFrame([("o1", 1, "update", "k", "z", 1), ("o1", 1, "update", "k", "z", 1), ("o2", 2, "update", "k", "late", 7), ("o3", 3, "add", "f", "back", None), ("o4", 4, "add", "n", "new", None), ("o5", 5, "update", "missing", "x", None)], "operation_id string, seq int, kind string, key string, statement string, expected long")
    state, done = memory.mutate(now, ops, ops.select("operation_id").limit(0))
    got = {r["key"]: (r["statement"], r["status"], r["revision"]) for r in state.collect()}
    assert got == {"k": ("z", "active", 2), "f": ("b", "forgotten", 4), "n": ("new", "active", 1)} and done.count() == 5
    again, _ = memory.mutate(state, ops, done)
    assert {r["key"]: r["revision"] for r in again.collect()} == {"k": 2, "f": 4, "n": 1}
    answers = spark.createDataFrame([("1", '{"memories": [{"category": "fact", "statement": "a", "confidence": "2", "confirmed": true}, {"category": "odd", "statement": "b", "confidence": 1}, {"category": "goal", "statement": " ", "confidence": 1}, {"category": "goal", "statement": "c", "confidence": "x"}]}'), ("2", "nothing"), ("3", None), ("4", '[{"category": "goal", "statement": "d", "confidence": 0.8}]')], "answer_id string, answer string")
    assert [(r["answer_id"], r["statement"], r["confidence"]) for r in memory.parsed(answers).orderBy("answer_id").collect()] == [("1", "a", 1.0), ("4", "d", 0.4)]


def test_research_checks(spark):
    a = spark.createDataFrame([("1", "说“备份策略”和「无此词」，耗时 5.0 秒，另 7 ms")], "answer_id string, answer string")
    lines = spark.createDataFrame([("1", "备份策略在此；耗时 5.04 秒")], "answer_id string, line string")
    heads = spark.createDataFrame([], "answer_id string, heading string")
    assert [tuple(r) for r in research.quoted_terms(a, lines, heads).collect()] == [("1", "无此词")]
    assert [tuple(r) for r in research.unsupported_claims(a, lines).collect()] == [("1", "7", "ms")]
    ev = spark.createDataFrame([("e1", "knowledge", "d", "ab", "t", ""), ("e2", "knowledge", "d", "xabx", "t", ""), ("e3", "knowledge", "z", "ab", "t", ""), ("e4", "knowledge", "z", "ab", "t", ""), ("e5", "web", "w", None, None, None)], "evidence_id string, source_type string, source_ref string, content string, title string, heading string")
    assert {r["evidence_id"] for r in research.deduplicated(ev).collect()} == {"e2", "e3", "e5"}
    assert [tuple(r)[1:] for r in research.merged_queries(spark.createDataFrame([("a", 1, "ADB 的备份?"), ("b", 2, " adb的备份！"), ("c", 3, "备份 ADB"), ("d", 4, "")], "query_id string, ord int, question string")).collect()][0][1] >= 2
    page = spark.createDataFrame([("p", "# A\ntext\n## B\nmore\n# C\n## D\nend here"), ("q", "")], "page_id string, text string")
    got = {r["page_id"]: (r["heading_path"], r["complete"]) for r in research.page_window(page, 30, 5).collect()}
    assert got == {"p": ("C > D", False), "q": ("", True)}


def test_vectors_and_migration(spark):
    old = spark.createDataFrame([("a", [1.0, 2.0])], "block_id string, embedding array<double>")
    with pytest.raises(Exception, match="2 finite"):
        ingest.upsert(old, spark.createDataFrame([("b", [1.0])], old.schema), 2).collect()
    assert ingest.upsert(old, spark.createDataFrame([("a", [3.0, 4.0]), ("a", [3.0, 4.0]), (None, [0.0, 0.0])], old.schema), 2).collect() == [("a", [3.0, 4.0])]
    assert {r["block_id"] for r in ingest.delete_where(spark.createDataFrame([("a", 1), ("b", None)], "block_id string, n int"), F.col("n") > 0).collect()} == {"b"}


def test_commits_and_queues(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    assert ingest.committed(spark, str(tmp_path / "none"), "t") is None
    assert ingest.commit_once(spark, {"t": df}, str(tmp_path / "c"), "op") and not ingest.commit_once(spark, {"t": df}, str(tmp_path / "c"), "op")
    assert ingest.committed(spark, str(tmp_path / "c"), "t").count() == 1
    q = spark.createDataFrame([("a", "1", "pending", 0, None), ("b", "x", "pending", 2, None), ("c", "1", "done", 1, "r"), ("d", "x", "failed", 3, "E")], "key string, payload string, state string, attempts int, result string")
    got = {r["key"]: (r["state"], r["attempts"], r["result"]) for r in ingest.attempt(q, lambda s: str(int(s))).collect()}
    assert got == {"a": ("done", 1, "1"), "b": ("failed", 3, "ValueError"), "c": ("done", 1, "r"), "d": ("failed", 3, "E")}


def test_a_crashed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.write_keyed(spark, one, path, "k")
    (tmp_path / "t" / "v000000002").mkdir()  # a write that never ended
    assert files.read_keyed(spark, path).count() == 2
    change = spark.createDataFrame([(2, "c")], "k int, v string")
    for _ in range(2):
        got = files.write_keyed(spark, change, path, "k", "op1")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c")] and files.versions(spark, path) == ["v000000001", "v000000002-op1"]


def test_files_are_taken_up_once(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.md").write_text("# A\n\nalpha")
    rows = lambda texts: texts.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.length("text").alias("n"))
    take = lambda: event_log.ingest(spark, str(root), str(tmp_path / "out"), str(tmp_path / "cp"), "name", rows)
    assert [tuple(r) for r in take().collect()] == [("a.md", 10)]
    (root / "b.md").write_bytes("中文".encode("gb18030"))
    assert sorted(tuple(r) for r in take().collect()) == [("a.md", 10), ("b.md", 2)] and take().count() == 2
    assert files.discover(spark, str(root / "none.md")).count() == 0 and files.discover(spark, str(root / "a.md")).first()["size"] == 10


def test_sets_are_checked(spark, tmp_path):
    import json

    good = [{"id": "1", "needs_answer": True, "question": "q", "targets": [{"source": "s", "grade": 3}]}, {"id": "2", "needs_answer": False, "question": "r", "targets": [{"source": "s", "grade": 0}]}]
    (tmp_path / "g.json").write_text(json.dumps(good))
    assert files.graded_set(spark, str(tmp_path / "g.json")).count() == 2
    good[1]["targets"][0]["grade"] = 7
    (tmp_path / "b.json").write_text(json.dumps(good))
    with pytest.raises(ValueError, match="1 with a wrong grade"):
        files.graded_set(spark, str(tmp_path / "b.json"))
    (tmp_path / "e.json").write_text(json.dumps([{"id": "1", "type": "a", "question": "q"}]))
    with pytest.raises(ValueError, match="too few"):
        files.eval_set(spark, str(tmp_path / "e.json"), 1, {"a": 2})
    files.write_json(spark, spark.createDataFrame([(1,)], "x int"), str(tmp_path / "store"))
    files.write_json(spark, spark.createDataFrame([(2,)], "x int"), str(tmp_path / "store"))
    assert [r[0] for r in spark.read.json(str(tmp_path / "store")).collect()] == [2]


def test_payloads(spark):
    e = spark.createDataFrame([("click", '{"k": "1"}'), ("click", '{"k": null}'), ("click", "{"), ("view", "{}"), ("view", None)], "event_type string, props string")
    assert [r["valid"] for r in ingest.valid_payloads(e, {"click": ["k"]}).collect()] == [True, False, False, True, False]


def test_subjects(spark):
    a, b = "alpha beta gamma " * 30, "delta epsilon zeta " * 30
    rows = [("d", "#0", "text", "", f"{a}\n\n{a}\n\n{b}\n\nshort tail"), ("d", "#1", "text", "H", f"{a}\n\n{b}"), ("d", "#2", "code", "", a), ("d", "#3", "text", "", "small"), ("d", "#4", "text", None, None)]
    c = spark.createDataFrame(rows, "doc_id string, block_id string, kind string, heading_path string, chunk string")
    got = {r["block_id"]: r["chunk"] for r in ingest.split_by_subject(c).collect()}
    assert set(got) == {"#0-s0", "#0-s1", "#1", "#3"} and got["#0-s1"].endswith("short tail")
