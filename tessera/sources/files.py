"""Files as DataFrames: directory scans, text decoding, JSON documents and evaluation sets, keyed writes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings tried in order for bytes that are not UTF-8 (fixed values).
FALLBACKS = ("gb18030", "cp1252")


def scan_files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path (relative), mtime, size of every matching file; hidden files and folders are skipped, contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file://")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + base.replace(".", "\\.") + "/", "")
    return files.select(relative.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content").where(~F.col("path").rlike(r"(^|/)\."))


def discover(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime, size, content_hash of one file; no row if it is gone or cannot be read."""
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
    shape = "path string, mtime timestamp, size long, content_hash string"
    if not there:
        return spark.createDataFrame([], shape)
    return files.load(path).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"))


def stat(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """The cheap scan: the content column is pruned from the source."""
    return scan_files(spark, root, pattern).drop("content")


def scan_directory(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path, filename, mtime, size, content_hash, text; undecodable bytes are replaced."""
    files = scan_files(spark, root, pattern)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "mtime", "size", F.sha2("content", 256).alias("content_hash"), decoded(F.col("content")).alias("text"))


def decoded(content):
    """Bytes as text: UTF-8 where valid (in the JVM), else the fallbacks, else UTF-8 with replacement. A mark at the start goes."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def other(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else decode(bytes(b)))

    text = content.cast("string")
    valid = F.is_valid_utf8(text)
    return F.coalesce(F.when(valid, F.regexp_replace(text, "^\ufeff", "")), other(F.when(~valid, content)))  # valid bytes do not reach the UDF


def decode(b: bytes) -> str:
    for encoding in ("utf-8-sig", *FALLBACKS):
        try:
            return b.decode(encoding)
        except UnicodeDecodeError:
            continue
    return b.decode("utf-8", "replace")


def only_changed(stats: DataFrame, manifest: DataFrame) -> DataFrame:
    """Of a cheap scan the files whose time or size differs from the manifest (path, mtime, size): only these need be read."""
    m = manifest.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    j = stats.join(m, "path", "left")
    return j.where(~(F.col("mtime").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s")))).drop("_m", "_s")


def conversations_json(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a JSON store of conversations with nested messages: conversation_id, title, message_index, role, content."""
    c = spark.read.option("multiLine", "true").schema("id string, title string, messages array<struct<role:string,content:string>>").json(path)
    return c.select(F.col("id").alias("conversation_id"), "title", F.posexplode("messages").alias("message_index", "m")).select("conversation_id", "title", "message_index", "m.role", "m.content")


EVAL = "id string, type string, question string, answerable boolean, answer_points array<string>, evidence array<struct<doc:string,snippet:string>>"


def eval_set(spark: SparkSession, path: str, least: int = 1, least_by_type: dict[str, int] | None = None) -> DataFrame:
    """A JSON evaluation set, checked: ids unique and not null, questions not empty, at least ``least`` items and so many of
    each kind."""
    q = spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(EVAL).json(path)
    c = q.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.coalesce(F.trim("question"), F.lit("")) == "").alias("blank")).first()
    if c["n"] < least or c["ids"] != c["n"] or c["blank"]:
        raise ValueError(f"evaluation set of {c['n']} items, {c['ids']} ids, {c['blank']} without a question")
    if least_by_type:
        kinds = {r["type"]: r["count"] for r in q.where(F.col("type").isin(list(least_by_type))).groupBy("type").count().collect()}
        short = {k: kinds.get(k, 0) for k, n in least_by_type.items() if kinds.get(k, 0) < n}
        if short:
            raise ValueError(f"too few items of {short}")
    return q


GRADED = "id string, family string, split string, needs_answer boolean, question string, targets array<struct<source:string,heading:string,evidence:array<string>,grade:int,group:string>>"


def graded_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON set of graded cases, checked: ids unique, grades 0 to 3, a required target (grade 3) exactly where an answer is
    needed."""
    q = spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(GRADED).json(path)
    required = F.exists(F.coalesce("targets", F.array().cast("array<struct<source:string,heading:string,evidence:array<string>,grade:int,group:string>>")), lambda t: t["grade"] == 3)
    wrong = F.exists("targets", lambda t: t["grade"].isNull() | ~t["grade"].between(0, 3))
    c = q.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.coalesce(wrong, F.lit(False))).alias("grades"), F.count_if(required != F.coalesce("needs_answer", F.lit(False))).alias("answers")).first()
    if c["ids"] != c["n"] or c["grades"] or c["answers"]:
        raise ValueError(f"{c['n']} cases, {c['ids']} ids, {c['grades']} with a wrong grade, {c['answers']} whose required targets do not fit")
    return q


def write_json(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """A JSON store replaced as a whole: written beside the old one, which goes when the new one is complete."""
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(f"{path}.new"), jvm.org.apache.hadoop.fs.Path(path)
    rows.write.mode("overwrite").json(f"{path}.new")
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        fs.delete(old, True)
    fs.rename(new, old)


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions of a keyed table, oldest first: folders v<number>[-<operation>] whose write has ended."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(root)]
    done = [n for n in names if re.fullmatch(r"v\d{9}(-.+)?", n) and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(done)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a keyed table."""
    return spark.read.parquet(f"{path}/{versions(spark, path)[-1]}")


def write_keyed(spark: SparkSession, changes: DataFrame, path: str, key: str, operation: str | None = None) -> DataFrame:
    """Upsert into the keyed table at ``path``: the merged table is written beside the others as a new version, which counts
    once its write has ended, so readers see the old or the new one and a crash leaves the old. An ``operation`` that a version
    is already named after changes nothing when it is repeated."""
    from tessera.operators.sync import merge

    known = versions(spark, path)
    if operation and any(n.partition("-")[2] == operation for n in known):
        return read_keyed(spark, path)
    merged = merge(spark.read.parquet(f"{path}/{known[-1]}"), changes, key) if known else changes
    number = int(known[-1][1:10]) + 1 if known else 1
    merged.write.mode("overwrite").parquet(f"{path}/v{number:09d}" + (f"-{operation}" if operation else ""))
    return read_keyed(spark, path)


def to_json_lines(df: DataFrame) -> Iterator[str]:
    """Rows as JSON, one at a time (for small reports)."""
    for row in df.toLocalIterator():
        yield json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str)
