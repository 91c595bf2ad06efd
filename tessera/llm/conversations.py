"""Problem 2: conversations rebuilt from message rows.

Method: keyed streaming state with event-time watermarks. Messages are grouped by conversation and segment (``SEGMENT``
successive sequence numbers, so that no conversation, however long, is one state); a segment's state buffers its messages,
merges deliveries of the same message, and on closure or event-time timeout emits the segment's turns and a summary.
Summaries form a monoid; two levels of small groups join them into one verdict per conversation.

The states of many segments lie together in a bucket, as columns (one Arrow batch), so that a micro-batch calls Python once a
bucket and not once a conversation; they are kept by RocksDB, outside the heap. ``delay`` bounds how long a segment waits for
rows out of order, so the state holds what is open and no more. A row later than that is dropped by the watermark, or opens
its segment again. Both are made good exactly: the deliveries each summary stands for are counted against the stored rows, and
a segment with several summaries or too few deliveries is built again from all of its rows; that last result counts.

The stored table is replayed as a stream in micro-batches of its files; when all are read, the query goes on from its
checkpoint with a closing row that moves the watermark beyond every timeout.

Defined results: rows without a conversation_id belong to none. Deliveries with the same message_id are one message; of
these the one with the smallest (created_at with nulls last, role, content) counts. A row without message_id is a
message of its own, equal only to rows equal in sequence, role and content. A null created_at counts as the earliest
time. A conversation is dropped as *broken* (a null, repeated, missing or out-of-range number, an unknown role, invisible
content), as *empty* (no user or assistant message) or for a *missing reply*; these are the rules of the statement. An
empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut, scratch_path

SEGMENT = 256  # sequence numbers per key of the state
FOLD = 1024  # segments joined at once at the first level
BROKEN = 64  # states of a conversation's messages without a valid number
BUCKET_ROWS, PART_ROWS = 5_000, 25_000  # stored rows of a bucket of states, and of a partition of the state
DELAY, TIMEOUT_S = "3 days", 3600
PARTS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Spellings of the roles after NFKC, case folding and removal of all but letters (fixed values).
ROLES = {
    "user": "user human customer client me person enduser 用户 使用者 人类 用戶 人類 客户 提问者 我 benutzer nutzer mensch anwender utilisateur humain usuario humano usuário ユーザー 人間 사용자 пользователь",
    "assistant": "assistant ai bot model chatbot agent gpt llm machine aiassistant assistent assistentin ki 助手 助理 人工智能 智能助手 机器人 模型 機器人 ai助手 ai助理 回答者 assistante ia asistente assistente アシスタント 어시스턴트 ассистент",
    "system": "system sys systemprompt developer 系统 系統 系统提示 système sistema システム 시스템 система",
    "tool": "tool tools function functioncall toolcall toolresult tooloutput 工具 函数 工具调用 工具结果 werkzeug outil herramienta ferramenta ツール 도구 инструмент",
}
ROLE_OF = {spelling: role for role, spellings in ROLES.items() for spelling in spellings.split()}


@lru_cache(4096)
def role_of(spelling: str | None) -> str | None:
    """user, assistant, system or tool; None for anything else."""
    if spelling is None:
        return None
    plain = "".join(ch for ch in unicodedata.normalize("NFKC", spelling).casefold() if ch.isalpha())
    return ROLE_OF.get(plain)


def visible(content: str | None) -> bool:
    """Whether anything of ``content`` shows: not only white space, controls, format characters, marks or fillers."""
    return content is not None and any(unicodedata.category(ch)[0] not in "ZCM" and ch not in "\u115f\u1160\u3164\uffa0\u2800" for ch in content)


OUT = "conversation_id string, segment long, kind string, sequence long, speaker string, message_id string, content string, n long, low long, high long, ok boolean, first string, last string, deliveries long"
OUT_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
ROWS = ["conversation_id", "segment", "message_id", "role", "content", "sequence", "event_ms", "created_us"]


def merge_message(held: dict[str, list], key: str, message: list) -> None:
    """Keep one delivery per message. ``message``: [created (µs or null), sequence, role, content]."""
    order = lambda m: (m[0] is None, m[0] or 0, m[2] or "", m[3] or "")
    if key not in held or order(message) < order(held[key]):
        held[key] = message


def summarise(messages: dict[str, list]) -> tuple[list[tuple], tuple]:
    """The turns of a segment, (sequence, speaker, message_id, content), and its summary, (n, low, high, ok, first, last)."""
    rows = sorted(((m[1], k, m) for k, m in messages.items()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    numbers = [r[0] for r in rows]
    ok = None not in numbers
    low, high = (numbers[0], numbers[-1]) if ok else (None, None)
    ok = ok and numbers == list(range(low, high + 1))
    turns, last = [], None
    for seq, key, m in rows:
        role = role_of(m[2])
        if role in ("user", "assistant"):
            if not visible(m[3]) or (role == "user" and last == "user"):
                ok = False
            turns.append((seq, role, key, m[3]))
            last = role
        elif role is None:
            ok = False
    return turns, (len(rows), low, high, ok, turns[0][1] if turns else None, last)


class Segments:
    """The open segments of a bucket: their messages, deliveries and last event times."""

    FIELDS = pa.schema([("c", pa.string()), ("s", pa.int64()), ("m", pa.string()), ("created", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("content", pa.string()), ("deliveries", pa.int64()), ("last", pa.int64())])

    def __init__(self, stored: bytes | None = None) -> None:
        self.open: dict[tuple[str, int], list] = {}  # messages by id, deliveries, last event time
        if stored:
            columns = pa.ipc.open_stream(stored).read_all().to_pydict()
            for c, s, m, created, seq, role, content, deliveries, last in zip(*columns.values(), strict=True):
                own = self.open.setdefault((c, s), [{}, 0, 0])
                own[0][m] = [created, seq, role, content]
                own[1:] = own[1] + deliveries, max(own[2], last)

    def stored(self) -> bytes:
        rows = [(c, s, m, *message, own[1] if n == 0 else 0, own[2]) for (c, s), own in self.open.items() for n, (m, message) in enumerate(own[0].items())]
        batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), self.FIELDS, strict=True)], schema=self.FIELDS)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.FIELDS) as writer:
            writer.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def add(self, frame: pd.DataFrame) -> None:
        frame = frame[ROWS].astype({"sequence": object, "created_us": object}).where(frame[ROWS].notna(), None)
        for c, s, m, role, content, seq, ms, us in zip(*[frame[x].tolist() for x in ROWS], strict=True):
            own = self.open.get((c, s))
            if own is None:
                own = self.open[c, s] = [{}, 0, 0]
            if s < 0:  # one such message breaks the conversation: its text need not be held
                m, seq, content = "broken", None, None
            merge_message(own[0], m, [None if us is None else int(us), None if seq is None else int(seq), role, content])
            own[1] += 1
            own[2] = max(own[2], ms)

    def close(self, until: float, turns: bool) -> pd.DataFrame:
        """The rows of the segments whose last message is ``until`` or earlier; they are no longer open."""
        rows = []
        for key in [k for k, own in self.open.items() if own[2] <= until]:
            messages, deliveries, _ = self.open.pop(key)
            own, summary = summarise(messages)
            if turns:
                rows += [(*key, "turn", *t, None, None, None, None, None, None, None) for t in own]
            rows.append((*key, "summary", None, None, None, None, *summary, deliveries))
        return pd.DataFrame(rows, columns=OUT_COLUMNS, dtype=object)


def keyed(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The columns ROWS of the messages that belong to a conversation."""
    own = F.coalesce("message_id", F.concat(F.lit("\0"), F.sha2(F.to_json(F.struct("sequence", "role", "content")), 256)))
    number = F.when(F.col("sequence") >= 1, F.floor((F.col("sequence") - 1) / segment)).otherwise(-1 - F.pmod(F.xxhash64("message_id", "content"), F.lit(BROKEN))).cast("long")
    return messages.where(F.col("conversation_id").isNotNull()).select("conversation_id", number.alias("segment"), own.alias("message_id"), "role", "content", F.col("sequence").cast("long").alias("sequence"), *[c for c in ("event_time",) if c in messages.columns], F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"))


def rebuild_stream(messages: DataFrame, delay: str, timeout_s: int, buckets: int, turns: bool = True, segment: int = SEGMENT) -> DataFrame:
    """The stateful operator on a streaming DataFrame with conversation_id, message_id, role, content, sequence, created_at and
    event_time; emits a segment's rows when its time is out."""
    wait = timeout_s * 1000
    rows = keyed(messages, segment).withColumns({"event_ms": F.unix_millis("event_time"), "bucket": F.pmod(F.xxhash64("conversation_id", "segment"), F.lit(buckets)).cast("int")})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = Segments(state.get[0] if state.exists else None)
        for frame in frames:
            held.add(frame)
        now = state.getCurrentWatermarkMs()
        out = held.close(now - wait, turns)
        if held.open:
            state.update((held.stored(),))
            state.setTimeoutTimestamp(min(own[2] for own in held.open.values()) + wait)
        elif state.exists:
            state.remove()
        yield out

    from pyspark.sql.streaming.state import GroupStateTimeout

    return rows.withWatermark("event_time", delay).groupBy("bucket").applyInPandasWithState(step, OUT, "messages binary", "append", GroupStateTimeout.EventTimeTimeout)


def stream_table(spark: SparkSession, path: str, files_per_trigger: int, delay: str, timeout_s: int, turns: bool) -> DataFrame:
    """Run the operator over the stored table ``path`` as a stream; the emitted rows, read from the shared folder."""
    stored = spark.read.parquet(path)
    span = stored.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"), F.count(F.lit(1)).alias("n")).first()
    low, high = (span["a"], span["b"]) if span["a"] is not None else (pd.Timestamp("2000-01-01"),) * 2
    parts = min(int(spark.conf.get(PARTS)), max(1, -(-span["n"] // PART_ROWS)))  # a micro-batch has a task for each, however small
    buckets = max(4 * parts, -(-span["n"] // BUCKET_ROWS))
    fields = ["conversation_id", "message_id", "role", "content", "sequence", "created_at"]
    shape = stored.select(*fields)
    closing, out, state = (scratch_path(spark, x) for x in ("closing", "conversations", "state"))
    shape.limit(0).write.parquet(closing)
    # a pattern that matches the path alone: the file source takes a plain path for a folder, and the table may be one file
    read = lambda p: spark.readStream.schema(shape.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{p[:-1]}[{p[-1]}]")
    rows = read(path).unionByName(read(closing))
    rows = rows.withColumn("event_time", F.coalesce(F.col("created_at").cast("timestamp"), F.lit(str(low)).cast("timestamp")))
    stream = rebuild_stream(rows, delay, timeout_s, buckets, turns)
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, PARTS: str(parts)}
    before = {name: spark.conf.get(name) for name in own}

    def run() -> None:
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()

    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        run()
        end = F.lit(str(pd.Timestamp(high) + 2 * pd.Timedelta(delay) + pd.Timedelta(seconds=2 * timeout_s + 3600))).cast("timestamp")
        row = [F.lit("\0close").alias("conversation_id"), *[F.lit(None).cast(shape.schema[f].dataType).alias(f) for f in fields[1:-1]], end.cast(shape.schema["created_at"].dataType).alias("created_at")]
        spark.range(1).select(*row).write.mode("append").parquet(closing)
        run()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(OUT).parquet(out).where(F.col("conversation_id") != "\0close")


def incomplete(stored: DataFrame, emitted: DataFrame) -> DataFrame:
    """conversation_id and segment of the segments that the stream emitted not at all, more than once or without late rows."""
    want = keyed(stored).groupBy("conversation_id", "segment").agg(F.count(F.lit(1)).alias("stored"))
    got = emitted.where("kind = 'summary'").groupBy("conversation_id", "segment").agg(F.count(F.lit(1)).alias("parts"), F.sum("deliveries").alias("got"))
    return want.join(got, ["conversation_id", "segment"], "left").where("parts IS NULL OR parts > 1 OR got <> stored").select("conversation_id", "segment")


def rebuild(rows: DataFrame, buckets: int, turns: bool) -> DataFrame:
    """The emitted rows of whole segments (columns ROWS without event_ms), at once. Deliveries of a message are joined before
    the shuffle."""
    order = F.struct(F.col("created_us").isNull().alias("late"), "created_us", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("content", F.lit("")).alias("c"), "role", "content", "sequence")
    one = rows.groupBy("conversation_id", "segment", "message_id").agg(F.min(order).alias("m")).select("conversation_id", "segment", "message_id", "m.role", "m.content", "m.sequence", F.lit(0).cast("long").alias("event_ms"), "m.created_us")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held = Segments()
        held.add(frame)
        return held.close(float("inf"), turns)

    return one.groupBy(F.pmod(F.xxhash64("conversation_id", "segment"), F.lit(buckets)).alias("bucket")).applyInPandas(run, OUT)


def replay(spark: SparkSession, path: str, files_per_trigger: int = 1000, timeout_s: int = TIMEOUT_S, delay: str = DELAY, turns: bool = True) -> DataFrame:
    """The emitted rows of the stored table, one summary for each segment: what the stream gave, and the segments that rows
    came too late for, built again."""
    stored = spark.read.parquet(path)
    emitted = stream_table(spark, path, files_per_trigger, delay, timeout_s, turns)
    again = cut(spark, incomplete(stored, emitted), "incomplete")
    n = again.count()
    if not n:
        return emitted
    keys = ["conversation_id", "segment"]
    late = rebuild(keyed(stored).join(again, keys, "left_semi"), max(int(spark.conf.get(PARTS)), -(-n * SEGMENT // BUCKET_ROWS)), turns)
    return emitted.join(again, keys, "left_anti").unionByName(late)


def _fold(df: DataFrame, keys: list[str]) -> DataFrame:
    """Join the summaries of each group in the order of ``segment``. A group has at most FOLD of them at the first level."""
    parts = F.array_sort(F.collect_list(F.struct("segment", "n", "low", "high", "ok", "first", "last")))
    grouped = df.groupBy(*keys).agg(parts.alias("p"))
    start = F.struct(F.lit(True).alias("ok"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("n"))

    def step(a, x):
        joined = a["high"].isNull() | x["low"].eqNullSafe(a["high"] + 1)
        reply = ~(a["last"].eqNullSafe("user") & x["first"].eqNullSafe("user"))
        return F.struct((a["ok"] & x["ok"] & joined & reply).alias("ok"), F.coalesce(a["low"], x["low"]).alias("low"), F.coalesce(x["high"], a["high"]).alias("high"), F.coalesce(a["first"], x["first"]).alias("first"), F.coalesce(x["last"], a["last"]).alias("last"), (a["n"] + x["n"]).alias("n"))

    return grouped.select(*keys, F.aggregate("p", start, step).alias("r")).select(*keys, "r.*")


def verdicts(emitted: DataFrame) -> DataFrame:
    """conversation_id, kept, messages: one row per conversation."""
    s = emitted.where("kind = 'summary'").select("conversation_id", "segment", "n", "low", "high", "ok", "first", "last")
    level = _fold(s.withColumn("block", F.floor(F.col("segment") / FOLD)), ["conversation_id", "block"])
    whole = _fold(level.withColumnRenamed("block", "segment"), ["conversation_id"])
    kept = F.col("ok") & F.col("low").eqNullSafe(1) & F.col("first").eqNullSafe("user") & F.col("last").eqNullSafe("assistant")
    return whole.select("conversation_id", F.coalesce(kept, F.lit(False)).alias("kept"), F.col("n").alias("messages"))


def found(spark: SparkSession, path: str) -> DataFrame:
    """p2_found: the conversations that must be dropped."""
    return verdicts(replay(spark, path, turns=False)).where(~F.col("kept")).select("conversation_id").distinct()


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """The kept conversations, one row per turn: conversation_id, sequence, speaker, message_id, content."""
    emitted = replay(spark, path)
    kept = verdicts(emitted).where("kept").select("conversation_id")
    turns = emitted.where("kind = 'turn'").select("conversation_id", "sequence", "speaker", "message_id", "content")
    return turns.join(kept, "conversation_id", "left_semi")
