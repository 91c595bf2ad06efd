"""Session factory and the shared folder every long job writes its intermediate tables to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def get_session(app: str = "tessera", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (adaptive execution, Arrow, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where the cluster names none (tests), a folder of this session.

    The fallback is for local masters only: on a cluster a machine-local folder would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with a number from 1 in a total order of all rows. Rows are divided into ranges of the order and written; each
    range is numbered by itself and offset by the sizes of those before it, so no task sorts everything."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(spark, df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_own", own).join(F.broadcast(sizes), "_range").withColumn(name, (F.col("_before") + F.col("_own")).cast("int")).drop("_range", "_own", "_before")


def bucketed(spark: SparkSession, df: DataFrame, key: str, name: str) -> DataFrame:
    """Like ``cut``, in buckets of ``key``: what is grouped or joined by it later moves no more. ``df`` should be partitioned by
    ``key`` (else each task writes a file for every bucket)."""
    path, parts = scratch_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
