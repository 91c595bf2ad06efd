"""Lexical search: an inverted index as a DataFrame, scored with BM25.

The postings (term, key, tf, dl) are one shuffle by term (partial counts first); a batch of queries joins them by term. Hot
terms are split by adaptive skew handling; the query side is small and broadcast only while Spark's own size estimate
allows it. Corpus statistics always cover all records, also when a search is filtered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import bucketed, cut

K1, B = 1.5, 0.75


#: A term that no text has: every record's own row, which carries its length into the corpus statistics.
RECORD = "\0"


SMALL = 32 << 20  # bytes for each core up to which a table is divided anew


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is small (by the planner's estimate, nothing is run for it): small tables come in few files
    and adaptive execution joins small partitions, but tokenising takes time. Large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def term_counts(records: DataFrame, key: str, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """key, dl (number of tokens), term, tf, and a row RECORD for each record; of the other terms those in ``wanted``.
    Texts are tokenised once; counting is partial per task before the shuffle."""
    toks = spread(records.select(key, text)).select(key, T.tokens(F.col(text)).alias("toks"))
    rows = toks.select(key, F.size("toks").alias("dl"), F.explode(F.array_append("toks", F.lit(RECORD))).alias("term"))
    if wanted is not None:  # a record's rows come together by its key alone, so that they may be stored in buckets of it
        rows = rows.join(wanted.select("term").unionByName(wanted.sparkSession.createDataFrame([(RECORD,)], "term string")), "term", "left_semi").repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return rows.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def with_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds n, avgdl and idf to rows with df; ``stats`` is one row."""
    return df.crossJoin(F.broadcast(stats)).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def document_frequency(records: DataFrame, key: str, text: str) -> DataFrame:
    """term, df, idf."""
    toks = spread(records.select(key, text)).select(T.tokens(F.col(text)).alias("toks"))
    rows = toks.select(F.size("toks").alias("dl"), F.explode(F.array_append(F.array_distinct("toks"), F.lit(RECORD))).alias("term"))
    df = cut(records.sparkSession, rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("dls")), "frequencies")
    stats = df.where(F.col("term") == RECORD).select(F.col("df").alias("n"), (F.col("dls") / F.col("df")).alias("avgdl"))
    return with_idf(df.where(F.col("term") != RECORD).select("term", "df"), stats).select("term", "df", "idf")


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """key, term and its place among the distinct informative terms, with the query's counts and anchor width."""
    toks = queries.select(key, F.array_distinct(T.tokens(F.col(text))).alias("terms"))
    informative = F.filter("terms", lambda t: ~T.is_low_information(t))
    toks = toks.withColumn("informative", informative).withColumns({
        "query_terms": F.size("terms"), "informative_query_terms": F.size("informative"),
        "identifier_query_terms": F.size(F.filter("informative", T.is_identifier)),
        "anchors": F.least(F.lit(6), F.greatest(F.lit(1), F.ceil(F.size("informative") * F.lit(0.4)))).cast("int"),
    })
    toks = toks.withColumns({"anchor_terms": F.slice("informative", 1, F.col("anchors"))}).withColumn("anchor_query_terms", F.size("anchor_terms"))
    return toks.select(key, "query_terms", "informative_query_terms", "identifier_query_terms", "anchor_query_terms", "anchor_terms", F.explode("terms").alias("term")).withColumns({
        "is_informative": ~T.is_low_information(F.col("term")), "is_anchor": F.array_contains("anchor_terms", F.col("term")),
        "is_named": ~T.is_low_information(F.col("term")) & T.is_identifier(F.col("term")),
    }).drop("anchor_terms")


def search(records: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int = 50, only: DataFrame | None = None) -> DataFrame:
    """The ``k`` best records of every query with score, rank and the evidence the gates use; ties by key.

    Only the postings of the queries' terms are kept, in buckets of the records (so the hits of a record and query, the most rows
    of a search, are summed where they are), in a table that the scores, their document frequencies and the corpus
    statistics are all read from. Document frequencies and lengths cover all records; hits are those among ``only`` (its key), if given,
    and ranks count those.
    """
    spark = records.sparkSession
    q = cut(spark, query_terms(queries, query_key, query_text), "query_terms")
    counts = bucketed(spark, term_counts(records, key, text, q.select("term").distinct()), key, "postings")
    stats = counts.where(F.col("term") == RECORD).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    postings = counts.where(F.col("term") != RECORD)
    idf = with_idf(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats).select("term", "idf", "n", "avgdl")
    weighed = cut(spark, q.join(idf, "term"), "weighed_terms")  # a row for each question and term: its size is known to the planner
    hits = (postings if only is None else postings.join(only.select(key), key, "left_semi")).join(weighed, "term")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    max_idf = F.log(1 + (F.col("n") - 0.5) / 0.5)
    scored = hits.groupBy(query_key, key).agg(
        F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("raw"),
        F.count(F.lit(1)).alias("matched_terms"), F.first("query_terms").alias("query_terms"),
        (F.sum("idf") / F.count(F.lit(1)) / F.first(max_idf)).alias("rarity"),
        F.count_if("is_informative").alias("informative_matched_terms"), F.first("informative_query_terms").alias("informative_query_terms"),
        F.count_if("is_named").alias("identifier_matched_terms"), F.first("identifier_query_terms").alias("identifier_query_terms"),
        F.count_if("is_anchor").alias("anchor_matched_terms"), F.first("anchor_query_terms").alias("anchor_query_terms"),
    )
    scored = scored.withColumns({"score": F.round("raw", 6), "rarity": F.round("rarity", 6), "coverage": F.round(F.col("matched_terms") / F.col("query_terms"), 6), "informative_coverage": F.round(F.when(F.col("informative_query_terms") > 0, F.col("informative_matched_terms") / F.col("informative_query_terms")).otherwise(0.0), 6)}).drop("raw")
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
