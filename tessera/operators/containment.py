"""Which short texts stand in which others, as equality joins: a needle meets the texts that hold its first characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4


def grams(c: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text."""
    at = F.sequence(F.lit(1), F.length(c) - (n - 1))
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(at, lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, hay: DataFrame, *within: str) -> DataFrame:
    """nid and hid of the needles (nid, needle) that stand in the texts (hid, text), of those equal in the columns ``within``.
    Empty needles and nulls are in none."""
    n = needles.where("length(needle) > 0").select("nid", "needle", *within, F.substring("needle", 1, GRAM).alias("gram"))
    every = F.flatten(F.array(*[grams(F.col("text"), k) for k in range(1, GRAM + 1)]))
    h = hay.where("length(text) > 0").select("hid", "text", *within, F.explode(every).alias("gram"))
    return n.join(h, ["gram", *within]).where(F.contains("text", "needle")).select("nid", "hid").distinct()


def sharing(a: DataFrame, b: DataFrame, n: int = GRAM, only: str = "^[一-鿿]+$") -> DataFrame:
    """nid and hid of the texts of ``a`` (nid, text) and ``b`` (hid, text) with a run of ``n`` characters of ``only`` in common."""
    runs = lambda df, key: df.select(key, F.explode(grams(F.col("text"), n)).alias("gram")).where(F.col("gram").rlike(only))
    return runs(a, "nid").join(runs(b, "hid"), "gram").select("nid", "hid").distinct()


def standing(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """needle and text of the needles (needle) that stand in the texts (text), each pair once. However many needles begin alike,
    the work follows the texts: a place of a text meets the lengths of the needles that begin as it does, then the needle of
    each such length, both by equality. Hashes only route; what they find is checked."""
    n = needles.where("length(needle) > 0").select("needle").distinct()
    sizes = [r[0] for r in n.select(F.least(F.length("needle"), F.lit(GRAM))).distinct().collect()]  # GRAM at most
    if not sizes:
        return needles.sparkSession.createDataFrame([], "needle string, text string")
    t = hay.where("length(text) > 0").select("text").distinct().withColumn("tid", F.xxhash64("text"))
    starts = n.groupBy(F.substring("needle", 1, GRAM).alias("gram")).agg(F.collect_set(F.length("needle")).alias("lengths"))
    c, length = F.col("text"), F.length("text")

    def places(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), length - (k - 1)), lambda i: F.struct(i.alias("at"), F.substr(c, i, F.lit(k)).alias("gram")))
        return F.when(length >= k, every).otherwise(F.array().cast("array<struct<at:int,gram:string>>"))

    at = t.select("tid", F.explode(F.flatten(F.array(*[places(k) for k in sizes]))).alias("p")).select("tid", "p.at", "p.gram")
    asked = at.join(starts, "gram").select("tid", "at", "lengths").join(t, "tid")
    fits = F.filter("lengths", lambda k: F.col("at") + k - 1 <= length)
    keys = asked.select("tid", "text", "at", F.explode(fits).alias("k")).select("tid", F.xxhash64(F.substr(c, F.col("at"), F.col("k"))).alias("key"))
    hits = keys.join(n.withColumn("key", F.xxhash64("needle")), "key").select("tid", "needle").distinct()
    return hits.join(t, "tid").where(F.contains("text", "needle")).select("needle", "text")
