"""From files to an index: manifests and scoped diffs, chunk rows, semantic splits, pictures, migration, the vector table,
progress, batches that are committed once.

Defined results: rows without a key are left out; copies of a path or block count once (the smallest row); empty inputs give
empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import text as T
from tessera.functions.vectors import cosine
from tessera.operators import sync
from tessera.operators.hybrid import hashed_embedding

SCHEMA_VERSION, ERRORS = 7, 50
SPLIT_MIN, SPLIT_BELOW, PART_MIN, CONTEXT = 800, 0.30, 120, 400


# ---- manifests


def uploaded(before: DataFrame, now: DataFrame, scope: str) -> DataFrame:
    """The diff of an upload into ``scope`` (a folder): as ``sync.diff``, but paths outside it are never deleted."""
    inside = F.col("path").startswith(scope.rstrip("/") + "/") if scope else F.lit(True)
    return sync.diff(before, now).where((F.col("action") != "deleted") | inside)


def applied(before: DataFrame, now: DataFrame, scope: str = "") -> tuple[DataFrame, DataFrame]:
    """The manifest (path, content_hash, mtime, size) after a sync, and its report (action, paths). Touched files get their new
    time, duplicates and deleted ones leave it."""
    d = uploaded(before, now, scope)
    fresh = now.join(d.where("action IN ('added', 'updated', 'touched', 'unchanged')").select("path"), "path", "left_semi")
    outside = before.join(d.select("path"), "path", "left_anti")
    manifest = fresh.select("path", "content_hash", "mtime", "size").unionByName(outside.select("path", "content_hash", "mtime", "size"))
    return manifest, d.groupBy("action").agg(F.count(F.lit(1)).alias("paths"))


def outcome(chunked: DataFrame) -> DataFrame:
    """One row over chunk rows (with error): documents, chunks, failed, and the distinct names of the errors (at most ERRORS)."""
    errors = F.array_join(F.slice(F.array_sort(F.collect_set("error")), 1, ERRORS), ",")
    return chunked.agg(F.countDistinct("doc_id").alias("documents"), F.count("chunk").alias("chunks"), F.countDistinct(F.when(F.col("error").isNotNull(), F.col("doc_id"))).alias("failed"), errors.alias("errors"))


# ---- chunks


def block_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The stored row of every chunk (doc_id, seq, kind, heading_path, anchor, chunk, block_id, aliases) with its document's path
    and content_hash: the global id, type, order, aliases as JSON, fingerprint of the text, and what it is embedded as."""
    d = documents.select("doc_id", "path", "content_hash")
    c = chunks.where("chunk IS NOT NULL").join(d, "doc_id")
    owner = F.substring(F.sha2("path", 256), 1, 32)
    kind = F.when(F.col("kind") == "image", "image_description").otherwise(F.col("kind"))
    return c.select(
        F.concat_ws("::", owner, "content_hash", "block_id").alias("block_id"), "doc_id", F.col("path").alias("source_file"), kind.alias("chunk_type"), "heading_path", "anchor", F.col("seq").alias("document_order"),
        F.to_json(F.coalesce("aliases", F.array().cast("array<string>"))).alias("heading_aliases"), F.sha2(F.col("chunk").cast("binary"), 256).alias("dedup_key"), F.col("chunk").alias("text"),
        T.embedding_text(F.col("path"), F.col("heading_path"), F.concat_ws("\n", S.informative_heading(F.col("heading_path")), "chunk")).alias("embedding_text"), F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def split_by_subject(chunks: DataFrame, least: int = SPLIT_MIN, below: float = SPLIT_BELOW, part: int = PART_MIN) -> DataFrame:
    """doc_id, block_id, chunk of text chunks: those without a heading, of ``least`` characters and two paragraphs, are cut where
    neighbouring paragraphs are under a cosine of ``below``; parts under ``part`` characters join their left neighbour; parts
    are numbered in the id (-s0, -s1, …). The paragraphs of a chunk are few and stay together."""
    paragraphs = F.filter(F.split("chunk", r"\n\s*\n"), lambda x: F.trim(x) != "")
    split = (F.coalesce(F.col("heading_path"), F.lit("")) == "") & (F.length("chunk") >= least) & (F.size(paragraphs) >= 2)
    text = chunks.where("kind = 'text' AND chunk IS NOT NULL").select("doc_id", "block_id", "chunk", split.alias("split"), paragraphs.alias("p"))
    p = text.where("split").select("doc_id", "block_id", F.posexplode("p").alias("n", "paragraph")).withColumn("v", hashed_embedding(F.col("paragraph")))
    w = Window.partitionBy("doc_id", "block_id").orderBy("n")
    cut = F.coalesce((F.round(cosine(F.lag("v").over(w), F.col("v")), 6) < below).cast("int"), F.lit(0))
    groups = p.withColumn("g", F.sum(cut).over(w)).groupBy("doc_id", "block_id", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "paragraph"))), lambda x: x["paragraph"]), "\n\n").alias("t"))
    listed = groups.groupBy("doc_id", "block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "t"))), lambda x: x["t"]).alias("ts"))
    fold = F.aggregate("ts", F.array().cast("array<string>"), lambda a, t: F.when((F.size(a) > 0) & (F.length(t) < part), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.element_at(a, -1), F.lit("\n\n"), t)))).otherwise(F.array_append(a, t)))
    parts = listed.select("doc_id", "block_id", F.posexplode(fold).alias("i", "chunk"))
    many = F.max("i").over(Window.partitionBy("doc_id", "block_id")) > 0
    named = parts.withColumn("block_id", F.when(many, F.concat("block_id", F.lit("-s"), F.col("i").cast("string"))).otherwise(F.col("block_id"))).drop("i")
    return named.unionByName(text.where("NOT split").select("doc_id", "block_id", "chunk"))


# ---- pictures


def picture_blocks(blocks: DataFrame, cache: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Each picture block (image_path or image_content_hash) with the state of its description: cached by path (``cache``:
    image_path, description), by content (``descriptions``: content_hash, description, created_at; the earliest), or pending;
    what is indexed of it; and the text under exactly its heading (distinct paragraphs, 400 characters)."""
    b = blocks.where("block_id IS NOT NULL").groupBy("block_id").agg(*[F.min(c).alias(c) for c in ("source_file", "heading_path", "chunk_type", "image_path", "image_content_hash", "text", "document_order")])
    pictures = b.where("chunk_type = 'image_description'")
    by_path = cache.groupBy("image_path").agg(F.min("description").alias("d1"))
    earliest = descriptions.groupBy(F.col("content_hash").alias("image_content_hash")).agg(F.min(F.struct(F.col("created_at").isNull().alias("n"), "created_at", "description")).alias("f")).select("image_content_hash", F.col("f.description").alias("d2"))
    # distinct paragraphs in reading order, as many as begin within the context: a heading with many blocks stays small
    part = b.where("chunk_type = 'text' AND coalesce(trim(heading_path), '') <> ''").select("source_file", "heading_path", "document_order", "block_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("i", "p")).withColumn("p", F.trim(F.regexp_replace("p", r"\s+", " "))).where("p <> ''")
    keys = ["source_file", "heading_path"]
    first = F.min(F.struct(F.col("document_order").isNull().alias("n"), "document_order", "block_id", "i", "p")).alias("f")
    part = part.groupBy(*keys, F.lower("p").alias("low")).agg(first)
    before = F.coalesce(F.sum(F.length("f.p") + 1).over(Window.partitionBy(*keys).orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prose = part.withColumn("before", before).where(F.col("before") < CONTEXT).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["p"]), "\n\n").alias("around"))
    j = pictures.join(by_path, "image_path", "left").join(earliest, "image_content_hash", "left").join(prose, ["source_file", "heading_path"], "left")
    state = F.when(F.col("d1").isNotNull(), "path").when(F.col("d2").isNotNull(), "content").otherwise("pending")
    return j.select("block_id", state.alias("state"), S.image_summary(F.coalesce("d1", "d2")).alias("indexed"), S.compact_context(F.coalesce("around", F.lit("")), CONTEXT).alias("context"))


# ---- the vector table


def upsert(current: DataFrame, rows: DataFrame, dim: int, key: str = "block_id", vector: str = "embedding") -> DataFrame:
    """``current`` with ``rows`` in the place of those with their keys; fails if a vector is not of ``dim`` finite numbers. A key
    that comes twice counts once (the smallest row)."""
    v = F.col(vector)
    good = F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    sound = rows.where(F.col(key).isNotNull()).where(F.when(good, True).otherwise(F.raise_error(F.lit(f"a vector is not of {dim} finite numbers")).cast("boolean")))
    once = sound.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("r")).select(key, "r.*")
    return sync.merge(current, once.select(*rows.columns), key)


def delete_where(current: DataFrame, predicate: Column) -> DataFrame:
    """``current`` without the rows that the predicate holds for (rows for which it is null stay)."""
    return current.where(~F.coalesce(predicate, F.lit(False)))


def blocks_of_source(blocks: DataFrame, source: str) -> DataFrame:
    """block_id and text of one file's blocks: the filter reaches the scan, other columns are not read."""
    return blocks.where(F.col("source_file") == source).select("block_id", "text")


def listed(blocks: DataFrame, vector: str = "embedding") -> DataFrame:
    """All columns but the vectors."""
    return blocks.select(*[c for c in blocks.columns if c != vector])


def migrated(old: DataFrame, new: DataFrame) -> DataFrame:
    """block_id, action and source of a change of representation: new blocks (block_id, doc_id, heading_path, text) take over the
    vector of an old one of the same document, heading and text (kept), or of the same text elsewhere in the document (moved, the
    text's vector stays but its row changes), else are embedded (new); old blocks that nothing took over are gone."""
    h = lambda df: df.where("block_id IS NOT NULL").select("block_id", "doc_id", F.coalesce("heading_path", F.lit("")).alias("hp"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h")).distinct()
    o, n = h(old), h(new)
    number = lambda df, keys, name: df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("block_id")))
    same = number(n, ["doc_id", "hp", "h"], "k").join(number(o, ["doc_id", "hp", "h"], "k").withColumnRenamed("block_id", "source"), ["doc_id", "hp", "h", "k"]).select("block_id", "source", F.lit("kept").alias("action"))
    n2, o2 = n.join(same.select("block_id"), "block_id", "left_anti"), o.join(same.select(F.col("source").alias("block_id")), "block_id", "left_anti")
    moved = number(n2, ["doc_id", "h"], "k").join(number(o2, ["doc_id", "h"], "k").select(F.col("block_id").alias("source"), "doc_id", "h", "k"), ["doc_id", "h", "k"]).select("block_id", "source", F.lit("moved").alias("action"))
    took = same.unionByName(moved)
    fresh = n.join(took.select("block_id"), "block_id", "left_anti").select("block_id", F.lit(None).cast("string").alias("source"), F.lit("new").alias("action"))
    gone = o.join(took.select(F.col("source").alias("block_id")), "block_id", "left_anti").select("block_id", F.lit(None).cast("string").alias("source"), F.lit("gone").alias("action"))
    return took.unionByName(fresh).unionByName(gone)


# ---- progress, batches


def progress(states: DataFrame) -> DataFrame:
    """Per task (task_id, path, state, at): files by the latest state of each, and whether it has ended."""
    last = states.groupBy("task_id", "path").agg(F.max(F.struct("at", "state")).alias("l")).select("task_id", "l.state")
    return last.groupBy("task_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"), F.bool_and(F.col("state").isin("done", "failed")).alias("ended"))


def commit_once(spark: SparkSession, tables: dict[str, DataFrame], path: str, operation: str) -> bool:
    """Write several tables as one commit: all into the folder of the operation, then its marker. What has a marker is never
    written again (False), what has none is written anew. Readers use ``committed``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    marker = hadoop(f"{path}/{operation}/_COMMITTED")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(marker):
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{operation}/{name}")
    fs.create(marker, True).close()
    return True


def committed(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The rows of a table over all commits, with the operation; None if there is no commit."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(x.getPath().getName() for x in (fs.listStatus(root) if fs.exists(root) else []) if fs.exists(hadoop(f"{path}/{x.getPath().getName()}/_COMMITTED")))
    out = None
    for op in done:
        df = spark.read.parquet(f"{path}/{op}/{name}").withColumn("operation", F.lit(op))
        out = df if out is None else out.unionByName(df)
    return out


def attempt(queue: DataFrame, work: Callable[[str], str], most: int = 3) -> DataFrame:
    """The queue (key, payload, state, attempts, result) after one pass: pending and failed rows under ``most`` attempts are
    worked on in the executors; a failure costs an attempt and is kept by its class name. Rows that are done stay as they are,
    so a pass that is repeated after a crash takes up what is pending."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, payload, state, attempts, result in frame.itertuples(index=False):
                if state != "done" and attempts < most:
                    attempts += 1
                    try:
                        state, result = "done", work(payload)
                    except Exception as e:  # noqa: BLE001 - one row must not end the pass
                        state, result = "failed", type(e).__name__
                rows.append((key, payload, state, attempts, result))
            yield pd.DataFrame(rows, columns=["key", "payload", "state", "attempts", "result"])

    return queue.select("key", "payload", "state", F.col("attempts").cast("int").alias("attempts"), "result").mapInPandas(run, "key string, payload string, state string, attempts int, result string")


def ordered_map(rows: DataFrame, ord_column: str, value: str, work: Callable[[str], str], parallel: int) -> DataFrame:
    """``ord_column`` and the result of ``work`` on each value, in at most ``parallel`` tasks at once; the results are in order of
    ``ord_column`` again. A failure is null with its class name in error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for n, v in frame.itertuples(index=False):
                try:
                    out.append((n, work(v), None))
                except Exception as e:  # noqa: BLE001
                    out.append((n, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["n", "result", "error"])

    kind = rows.schema[ord_column].dataType.simpleString()
    done = rows.select(ord_column, value).repartition(parallel).mapInPandas(run, f"n {kind}, result string, error string")
    return done.withColumnRenamed("n", ord_column).orderBy(ord_column)


def valid_payloads(events: DataFrame, fields: dict[str, list[str]], kind: str = "event_type", payload: str = "props") -> DataFrame:
    """``events`` and whether each payload is a JSON object with the fields that its type needs, none of them null; types that
    are not listed need none."""
    parsed = F.from_json(F.when(F.try_parse_json(payload).isNotNull(), F.col(payload)), "map<string,string>")
    rule = F.lit(True)
    for name, own in fields.items():
        there = F.lit(True)
        for f in own:
            there &= F.element_at(parsed, f).isNotNull()
        rule = F.when(F.col(kind) == name, there).otherwise(rule)
    return events.withColumn("valid", F.coalesce(parsed.isNotNull() & rule, F.lit(False)))
