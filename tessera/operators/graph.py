"""Dependencies."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut, scratch_path


def layers(spark: SparkSession, nodes: DataFrame, needs: DataFrame, most: int | None = None) -> DataFrame:
    """id and layer: a node is in the first layer after all it needs. ``needs`` has id and needs; what a node needs and is
    no node itself is taken as there. Nodes on a cycle, and after one, have no layer. Each round is one join and one
    aggregate, written to the shared folder; the rounds are the depth of the graph. Raises if nodes are ready after ``most``
    rounds (none: as many as the graph is deep)."""
    known = nodes.select(F.col("id").alias("needs"))
    edges = needs.select("id", "needs").distinct().join(known, "needs", "left_semi")
    rest = cut(spark, nodes.select("id").distinct(), "layers")
    kind, paths = nodes.select("id").withColumn("layer", F.lit(0)).schema, []
    for layer in count():
        blocked = edges.join(rest.select(F.col("id").alias("needs")), "needs", "left_semi").select("id").distinct()
        paths.append(scratch_path(spark, "layers"))
        rest.join(blocked, "id", "left_anti").withColumn("layer", F.lit(layer)).write.parquet(paths[-1])
        ready = spark.read.schema(kind).parquet(paths[-1])
        if not ready.limit(1).count():
            return spark.read.schema(kind).parquet(*paths)
        if layer == most:
            raise RuntimeError(f"nodes are ready after {most} rounds")
        rest = cut(spark, rest.join(ready.select("id"), "id", "left_anti"), "layers")
