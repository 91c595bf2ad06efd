import inspect
import json

import pytest

from tessera.functions import queries as Q
from tessera.operators import graph
from tessera.sources import files
from tessera.streaming import event_log


def test_directory_scan(spark, tmp_path):
    for name, data in {"a.md": b"# A", "sub/b.md": "中文".encode("gb18030"), ".hidden/c.md": b"x", "d.txt": b"x", "sub/.e.md": b"x", "bom.md": b"\xef\xbb\xbfok"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    got = {r["path"]: r for r in files.scan_directory(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "sub/b.md", "bom.md"}
    assert got["sub/b.md"]["text"] == "中文" and got["bom.md"]["text"] == "ok" and got["a.md"]["size"] == 3 and got["sub/b.md"]["filename"] == "b.md"
    stats = files.stat(spark, str(tmp_path))
    assert "content" not in stats.columns
    assert files.only_changed(stats, stats.where("path <> 'a.md'").select("path", "mtime", "size")).select("path").collect()[0][0] == "a.md"
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_json_stores(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "title": "t", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"id": "2", "title": None, "messages": []}]))
    assert [tuple(r) for r in files.conversations_json(spark, str(tmp_path / "c.json")).orderBy("message_index").collect()] == [("1", "t", 0, "user", "a"), ("1", "t", 1, "assistant", "b")]
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": "q?", "answerable": True}, {"id": "2", "question": "r?"}]))
    assert files.eval_set(spark, str(tmp_path / "q.json")).count() == 2
    (tmp_path / "bad.json").write_text(json.dumps([{"id": "1", "question": "q?"}, {"id": "1", "question": ""}]))
    with pytest.raises(ValueError, match="1 ids"):
        files.eval_set(spark, str(tmp_path / "bad.json"))


def test_keyed_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.write_keyed(spark, one, path, "k")
    for _ in range(2):
        got = files.write_keyed(spark, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, "k")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert len(list(files.to_json_lines(got))) == 3


@pytest.mark.parametrize(
    ("question", "want"),
    [("请问分表的方案是什么样的？", "分表方案"), ("我好像记得京东的对比详情是什么样的", "京东对比详情"), ("keep this", "keep this"), ("", ""), (None, ""), ("请问", "请问")],
)
def test_plain_questions(question, want):
    assert Q.plain_question(question) == want


@pytest.mark.parametrize(("question", "want"), [("什么是 ADB？", "ADB"), ("请问一下什么是ADB", "ADB"), ("Warebase 是什么", "Warebase"), ("ADB 事故的根因是什么", None), (None, None)])
def test_definition_subjects(question, want):
    assert Q.definition_subject(question) == want


def test_variants(spark):
    q = spark.createDataFrame([("1", "请问缓存的机制"), ("2", "cache"), ("3", ""), ("4", None)], "id string, question string")
    assert [(r["id"], r["kind"]) for r in Q.variants(q, "id", "question").orderBy("id", "ord").collect()] == [("1", "original"), ("1", "normalized"), ("2", "original")]


def test_layers_with_a_cycle(spark):
    n = spark.createDataFrame([(i,) for i in range(7)], "id long")
    e = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 4), (4, 3), (5, 3), (6, 99)], "id long, needs long")
    assert {r["id"]: r["layer"] for r in graph.layers(spark, n, e).collect()} == {0: 0, 1: 1, 2: 2, 6: 0}
    assert graph.layers(spark, n.limit(0), e).count() == 0


def test_layers_deeper_than_a_bound(spark):
    n = spark.createDataFrame([(i,) for i in range(5)], "id long")
    e = spark.createDataFrame([(i, i - 1) for i in range(1, 5)], "id long, needs long")
    with pytest.raises(RuntimeError):
        graph.layers(spark, n, e, 4)
    for most in (5, None):
        assert {r["id"]: r["layer"] for r in graph.layers(spark, n, e, most).collect()} == {i: i for i in range(5)}
    assert inspect.signature(graph.layers).parameters["most"].default is None  # no bound of its own


def test_numbers_across_micro_batches(spark, tmp_path):
    rows = [(i, i % 3, f"2024-01-01 00:{i:02}:00") for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "cast(ts AS timestamp) AS ts")
    df.repartitionByRange(4, "event_id").write.parquet(str(tmp_path / "e"))
    got = event_log.run(spark, event_log.numbered(event_log.read_table(spark, f"file://{tmp_path}/e", 1), "user_id", "long", "event_id", "long", "ts"), "n").collect()
    for u in range(3):
        assert sorted(r["event_seq"] for r in got if r["user_id"] == u) == list(range(1, 11))
