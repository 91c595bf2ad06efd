import datetime as dt
import itertools
import random
import re
import time

import pandas as pd
import pytest

from tessera.llm import conversations as C

SCHEMA = "message_id string, conversation_id string, role string, content string, created_at timestamp, sequence int, kept string"
T0 = dt.datetime(2024, 1, 1)


def write(spark, tmp_path, rows, name):
    path = f"{tmp_path}/{name}.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return f"file://{path}"


def conversation(cid, roles, start=1, **change):
    return [(f"{cid}-{i}", cid, r, change.get("content", "text"), T0 + dt.timedelta(days=(i * 37) % 11), start + i, "x") for i, r in enumerate(roles)]


def test_rules(spark, tmp_path):
    rows = conversation("ok", ["user", " Assistant", "USER", "tool", "AI", "助手"]) + conversation("ok2", ["system", "用户", "assistant"])
    rows += rows[:2] + [rows[0][:4] + (None,) + rows[0][5:]]  # delivered again
    rows += conversation("gap", ["user", "assistant"], start=2) + conversation("first", ["assistant", "user", "assistant"]) + conversation("noreply", ["user", "assistant", "user"])
    rows += conversation("twice", ["user", "user", "assistant"]) + conversation("blank", ["user", "assistant"], content="\u200b\u00a0\ufeff") + conversation("role", ["user", "n/a", "assistant"]) + conversation("onlytool", ["tool"])
    rows += conversation("nullrole", ["user", None, "assistant"]) + [("n1", "nullseq", "user", "x", T0, None, "x"), ("s1", "same", "user", "x", T0, 1, "x"), ("s2", "same", "assistant", "x", T0, 1, "x"), ("z", None, "user", "x", T0, 1, "x")]
    rows += [(None, "noid", "user", "x", T0, 1, "x"), (None, "noid", "user", "x", None, 1, "y"), ("a", "noid", "ai", "y", T0, 2, "x")]
    path = write(spark, tmp_path, rows, "h")
    dropped = {r[0] for r in C.found(spark, path).collect()}
    assert dropped == {"gap", "first", "noreply", "twice", "blank", "role", "onlytool", "nullrole", "nullseq", "same"}
    turns = C.conversations(spark, path).where("conversation_id = 'ok'").orderBy("sequence").collect()
    assert [(t["sequence"], t["speaker"]) for t in turns] == [(1, "user"), (2, "assistant"), (3, "user"), (5, "assistant"), (6, "assistant")]


def test_long_conversations_are_joined_from_segments(spark, tmp_path):
    roles = list(itertools.islice(itertools.cycle(["user", "assistant"]), 2 * C.SEGMENT + 40))
    bad = roles.copy()
    bad[C.SEGMENT] = bad[C.SEGMENT - 1] = "user"  # two questions across the border of two segments
    rows = conversation("long", roles) + conversation("bad", bad) + [r for r in conversation("hole", roles) if r[5] != C.SEGMENT + 1]
    random.Random(1).shuffle(rows)
    assert {r[0] for r in C.found(spark, write(spark, tmp_path, rows, "l")).collect()} == {"bad", "hole"}


def test_small_batches_give_the_same(spark, tmp_path):
    rows = conversation("a", ["user", "ai"] * 5) + conversation("b", ["user"]) + conversation("c", ["user", "ai", "ai"])
    path = write(spark, tmp_path, rows, "s")
    got = C.verdicts(C.replay(spark, path, files_per_trigger=1)).collect()
    assert {r["conversation_id"]: r["kept"] for r in got} == {"a": True, "b": False, "c": True}


def test_empty_table(spark, tmp_path):
    assert C.found(spark, write(spark, tmp_path, [], "e")).count() == 0


@pytest.mark.parametrize(("spelling", "role"), [("Human", "user"), ("\uff35\uff33\uff25\uff32", "user"), (" assistant ", "assistant"), ("助手", "assistant"), ("System", "system"), ("n/a", None), ("", None), (None, None)])
def test_roles(spelling, role):
    assert C.role_of(spelling) == role


def test_summary_against_the_rule():
    r = random.Random(5)
    for _ in range(300):
        roles = [r.choice(["user", "assistant", "tool"]) for _ in range(r.randint(1, 6))]
        _, (n, low, high, ok, first, last) = C.summarise({str(i): [None, i + 1, x, "t"] for i, x in enumerate(roles)})
        q = "".join(x[0] for x in roles if x != "tool")
        assert (ok and first == "user" and last == "assistant") == bool(re.fullmatch("(ua+)+", q))
        assert (n, low, high) == (len(roles), 1, len(roles))


def test_late_rows_are_made_good(spark, tmp_path):
    """Rows later than the delay are dropped by the watermark, or open a closed segment again; the result is that of all rows."""
    early = conversation("a", ["user", "ai"]) + conversation("b", ["user"]) + conversation("d", ["user", "ai", "user"])
    far = [(f"x{i}", "x", r, "t", T0 + dt.timedelta(days=400), i + 1, "x") for i, r in enumerate(["user", "ai"])]
    late = [("b-1", "b", "ai", "answer", T0 + dt.timedelta(days=1), 2, "x"), ("a-2", "a", "user", "again", T0, 3, "x"), ("e-1", "e", "user", "x", T0, 1, "x"), ("e-2", "e", "ai", "x", None, 2, "x")]
    again = [("d-3", "d", "ai", "answer", T0 + dt.timedelta(days=500), 4, "x")]
    path = f"{tmp_path}/late.parquet"
    for rows in (early, far, late, again):  # the file source reads in order of time
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    emitted = C.stream_table(spark, f"file://{path}", 1, "1 day", 60, True)
    missing = {r[0] for r in C.incomplete(spark.read.parquet(path), emitted).collect()}
    assert missing & {"a", "b", "e"} and "x" not in missing
    got = C.replay(spark, f"file://{path}", files_per_trigger=1, delay="1 day", timeout_s=60)
    assert {r["conversation_id"]: r["kept"] for r in C.verdicts(got).collect()} == {"a": False, "b": True, "d": True, "e": True, "x": True}
    assert got.where("conversation_id = 'b' AND kind = 'turn'").count() == 2


def test_state_columns_round_trip():
    held = C.Segments()
    held.add(pd.DataFrame([("c", 0, "m", "user", "t", 1, 5, 7), ("c", 0, "m", "user", "t", 1, 9, None), ("c", -3, "n", None, None, None, 4, None)], columns=C.ROWS))
    back = C.Segments(held.stored())
    assert back.open == held.open == {("c", 0): [{"m": [7, 1, "user", "t"]}, 2, 9], ("c", -3): [{"broken": [None, None, None, None]}, 1, 4]}
    assert len(back.close(4, True)) == 1 and list(back.open) == [("c", 0)]
