"""The event log as a stream: gap-free numbers per key, idempotent appends, late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.session import scratch_path


def read_table(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stored table as a stream (a pattern that matches the path alone, as the table may be a single file)."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def run(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now; its output, read from the shared folder."""
    out = scratch_path(spark, name)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", scratch_path(spark, "state")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def numbered(events: DataFrame, key: str, key_type: str, id_col: str, id_type: str, time: str) -> DataFrame:
    """``key``, ``id_col``, event_seq: each key's events numbered without gaps across micro-batches. The state of a key is one number."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        own = pd.concat(list(frames)).sort_values([time, id_col])
        state.update((n + len(own),))
        yield pd.DataFrame({key: [k[0]] * len(own), id_col: own[id_col].to_numpy(), "event_seq": range(n + 1, n + 1 + len(own))})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, {id_col} {id_type}, event_seq long", "n long", "append", GroupStateTimeout.NoTimeout)


def once(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windows(events: DataFrame, time: str, size: str, delay: str, *by: str) -> DataFrame:
    """Counts per window; a window is emitted when the watermark has passed its end."""
    return events.withWatermark(time, delay).groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n"))


def tail(events: DataFrame, run: str, seq: str, kind: str, offset: int, terminal: list[str]) -> DataFrame:
    """``run``, ``seq`` and ``kind`` of a stream of numbered events after ``offset``, each once however often it is delivered, in
    order within a micro-batch, up to the run's first terminal event. The state of a run is its last number and whether it ended;
    events that arrive below the last number are taken as delivered before."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in (run, seq, kind)}

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, ended = state.get if state.exists else (offset, False)
        own = pd.concat(list(frames)).drop_duplicates(seq).sort_values(seq)
        out = []
        for s, t in zip(own[seq], own[kind], strict=True):
            if not ended and s > last:
                out.append((k[0], s, t))
                last, ended = int(s), t in terminal
        state.update((last, ended))
        yield pd.DataFrame(out, columns=[run, seq, kind])

    return events.groupBy(run).applyInPandasWithState(step, f"{run} {kinds[run]}, {seq} {kinds[seq]}, {kind} {kinds[kind]}", "last long, ended boolean", "append", GroupStateTimeout.NoTimeout)


def ingest(spark: SparkSession, root: str, table: str, checkpoint: str, key: str, rows, pattern: str = "*.md") -> DataFrame:
    """Take up the new files below ``root`` once: each micro-batch of files becomes rows (``rows`` of path and text) that are merged
    into the keyed table under the batch's number, so a batch that is repeated after a crash changes nothing. Returns the table."""
    from tessera.sources import files

    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)

    def merge(batch: DataFrame, number: int) -> None:
        texts = batch.where(~F.col("path").rlike(r"/\.")).select("path", files.decoded(F.col("content")).alias("text"))
        files.write_keyed(batch.sparkSession, rows(texts), table, key, f"b{number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return files.read_keyed(spark, table)
