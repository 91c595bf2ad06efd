"""Graded relevance: judging, measures by case, roll-ups, gates.

Views are what a search scored or returned: query_id, key, rank, chars, returned. Grades are query_id, key, ord, grade, grp: the
targets of the case that the view meets, in the order of the case (3 required, 2 helpful, 1 topic only, 0 not; grp is the group
of required evidence a target belongs to, else null). Forbidden are query_id and key of hard negatives. Cases are query_id,
needs_answer, groups (how many required ones), and the columns to roll up by.

Defined results: a view that meets no target is unjudged (null, never 0); with an unjudged view returned a case has no precision.
Cases without views count. Averages leave out nulls. Empty tables give no cases and null measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The limits of the gate (fixed values).
GATE = {"precision": 0.90, "family_precision": 0.85, "recall": 0.95, "family_recall": 0.90, "hard_negatives": 0.05, "empty_false_context": 0.0}


def judge(views: DataFrame, grades: DataFrame) -> DataFrame:
    """``views`` with the grade of the first target each meets, else null."""
    first = grades.groupBy("query_id", "key").agg(F.min_by("grade", "ord").alias("grade"))
    return views.join(first, ["query_id", "key"], "left")


def by_case(views: DataFrame, grades: DataFrame, forbidden: DataFrame, cases: DataFrame) -> DataFrame:
    """``cases`` with the measures of each: returned, relevant, unjudged, precision, recall, coverage (recall among all that was
    scored), hard_scored, hard_returned, judged_chars, irrelevant_chars, empty_false."""
    judged = judge(views, grades).join(forbidden.distinct().withColumn("hard", F.lit(True)), ["query_id", "key"], "left")
    ret, c = F.col("returned"), F.col
    per = judged.groupBy("query_id").agg(
        F.count_if(ret).alias("returned"), F.count_if(ret & (c("grade") >= 2)).alias("relevant"), F.count_if(ret & c("grade").isNull()).alias("unjudged"),
        F.count_if(c("hard")).alias("hard_scored"), F.count_if(ret & c("hard")).alias("hard_returned"),
        F.coalesce(F.sum(F.when(ret & c("grade").isNotNull(), c("chars"))), F.lit(0)).alias("judged_chars"), F.coalesce(F.sum(F.when(ret & (c("grade") <= 1), c("chars"))), F.lit(0)).alias("irrelevant_chars"),
    )
    met = views.select("query_id", "key", "returned").join(grades.where("grp IS NOT NULL").select("query_id", "key", "grp").distinct(), ["query_id", "key"])
    met = met.groupBy("query_id").agg(F.countDistinct("grp").alias("met_scored"), F.countDistinct(F.when(ret, c("grp"))).alias("met_returned"))
    out = cases.join(per, "query_id", "left").join(met, "query_id", "left").fillna(0, ["returned", "relevant", "unjudged", "hard_scored", "hard_returned", "judged_chars", "irrelevant_chars", "met_scored", "met_returned"])
    part = lambda x: F.when(c("groups") > 0, c(x) / c("groups"))
    return out.withColumns({
        "precision": F.when((c("returned") > 0) & (c("unjudged") == 0), c("relevant") / c("returned")), "recall": part("met_returned"), "coverage": part("met_scored"),
        "empty_false": F.when(~c("needs_answer"), c("returned") > 0),
    })


def measures() -> list[Column]:
    c = F.col
    ratio = lambda a, b: F.round(F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)), 6)
    precise = F.when(c("precision").isNotNull(), c("returned"))
    return [
        F.count(F.lit(1)).alias("cases"), F.round(F.avg("precision"), 6).alias("precision_macro"), ratio(F.when(c("precision").isNotNull(), c("relevant")), precise).alias("precision_micro"), F.round(F.avg("recall"), 6).alias("recall_macro"),
        ratio("met_returned", "groups").alias("recall_micro"), F.round(F.avg("coverage"), 6).alias("candidate_coverage"), ratio("hard_returned", "hard_scored").alias("hard_negative_rate"),
        F.round(F.avg(c("empty_false").cast("double")), 6).alias("empty_false_context"), ratio("irrelevant_chars", "judged_chars").alias("irrelevant_char_ratio"), F.sum("unjudged").alias("unjudged"),
    ]


def report(measured: DataFrame, *by: str) -> DataFrame:
    """The measures of all cases and by each of the columns (one pass over grouping sets); level is 'all' or the column."""
    grouped = measured.groupingSets([[], *([F.col(b)] for b in by)], *[F.col(b) for b in by])
    level = F.lit("all")
    for b in by:
        level = F.when(F.grouping(b) == 0, F.lit(b)).otherwise(level)
    value = F.coalesce(*[F.when(F.grouping(b) == 0, F.coalesce(F.col(b).cast("string"), F.lit(""))) for b in by], F.lit("")) if by else F.lit("")
    out = grouped.agg(*measures(), level.alias("level"), value.alias("value"))
    return out.select("level", "value", *[m for m in out.columns if m not in (*by, "level", "value")])


def gate(reported: DataFrame, family: str, limits: dict = GATE) -> DataFrame:
    """level, value, passes and the failed measures of the whole and of every family. A rate without samples fails only where
    the gate needs one (the empty false context of the whole)."""
    whole, c = F.col("level") == "all", F.col
    p, r = F.when(whole, limits["precision"]).otherwise(limits["family_precision"]), F.when(whole, limits["recall"]).otherwise(limits["family_recall"])
    fails = F.array(
        F.when(whole & (c("unjudged") > 0), "unjudged"), F.when(F.coalesce(c("precision_macro") < p, whole), "precision"), F.when(F.coalesce(c("recall_macro") < r, whole), "recall"),
        F.when(whole & (c("hard_negative_rate") > limits["hard_negatives"]), "hard_negatives"), F.when(whole & F.coalesce(c("empty_false_context") > limits["empty_false_context"], F.lit(True)), "empty_false_context"),
    )
    named = reported.where(whole | (c("level") == family)).withColumn("failed", F.array_join(F.filter(fails, lambda x: x.isNotNull()), "+"))
    return named.select("level", "value", (c("failed") == "").alias("passes"), "failed")


def retrieval_bench(hits: DataFrame, relevant: DataFrame, wanted: DataFrame, k: int = 8) -> DataFrame:
    """Per question with targets: rr, ndcg, evidence (share of its targets found), pollution (share of hits that are none) and
    duplicates (share of hits whose text came before), of the first ``k`` hits (query_id, key, rank, text_hash)."""
    top = hits.where(F.col("rank") <= k).join(relevant.select("query_id", "key").distinct().withColumn("rel", F.lit(1)), ["query_id", "key"], "left")
    per = top.groupBy("query_id").agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.count("rel").alias("found"), F.count(F.lit(1)).alias("n"), F.countDistinct("text_hash").alias("texts"), F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("targets").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    j = wanted.where("targets > 0").join(per, "query_id", "left")
    z = lambda e: F.round(F.coalesce(e, F.lit(0.0)), 6)
    return j.select("query_id", z(1 / F.col("first")).alias("rr"), z(F.col("dcg") / ideal).alias("ndcg"), z(F.col("found") / F.least("targets", F.lit(k))).alias("evidence"), z(1 - F.col("found") / F.col("n")).alias("pollution"), z(1 - F.col("texts") / F.col("n")).alias("duplicates"))


def merge_private(public: DataFrame, private: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Public cases with the private columns of theirs. The private side names the hash of the public content it was written
    for; a case whose content has changed since, or that has no public side, fails the merge."""
    own = public.withColumn("_hash", F.sha2(F.to_json(F.struct(*content)), 256))
    j = private.withColumnRenamed(key, "_key").join(own, F.col("_key") == F.col(key), "left")
    wrong = j.where(F.col(key).isNull() | ~F.col("_hash").eqNullSafe(F.col("content_hash"))).count()
    if wrong:
        raise ValueError(f"{wrong} private cases do not fit a public one")
    return own.drop("_hash").join(private.drop("content_hash"), key, "left")
