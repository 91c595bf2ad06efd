"""Queries: conversations, memory sections, containment, budgets, layers, question variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import queries as Q
from tessera.functions import text as T
from tessera.operators import catalog, graph
from tessera.plans.catalog import query
from tessera.tables import table


@query("query_variants")
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    """Each question with its plain form where that has other terms (language rules: no SQL; tested by cases)."""
    return Q.variants(table(spark, d, "eval_questions"), "id", "question")


@query("distinct_queries", """WITH q AS (SELECT id, lower(regexp_replace(question, '[\\s，,。.？?！!、；;：:"''“”‘’（）()《》<>\\[\\]【】]+', '', 'g')) AS k FROM eval_questions) SELECT min(id) AS id, count(*) AS n FROM q GROUP BY k""")
def distinct_queries(spark: SparkSession, d: str) -> DataFrame:
    """Questions once by their canonical key, the first id stays."""
    return table(spark, d, "eval_questions").groupBy(T.canonical_query(F.col("question")).alias("k")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).drop("k")


@query("conversation_search", "WITH c AS (SELECT conversation_id, lower(string_agg(DISTINCT content, chr(10))) AS t FROM history_messages WHERE lower(trim(role)) IN ('user', 'assistant') GROUP BY conversation_id) SELECT conversation_id FROM c WHERE contains(t, 'glossary') AND contains(t, 'budget')")
def conversation_search(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose messages hold all terms somewhere. Flags are aggregated, the texts are not joined."""
    m = table(spark, d, "history_messages").where("lower(trim(role)) IN ('user', 'assistant')")
    return catalog.conversations_with(m, ["glossary", "budget"])


@query("conversation_search_all", "WITH c AS (SELECT conversation_id, lower(string_agg(DISTINCT content, chr(10))) AS t FROM history_messages WHERE lower(trim(role)) IN ('user', 'human', '用户', 'assistant', 'ai', '助手') GROUP BY conversation_id) SELECT conversation_id FROM c WHERE contains(t, 'glossary') AND contains(t, 'budget')")
def conversation_search_all(spark: SparkSession, d: str) -> DataFrame:
    """The same over the messages of user and assistant in every spelling of their roles."""
    m = table(spark, d, "history_messages").where(catalog.speaker(F.col("role")).isNotNull())
    return catalog.conversations_with(m, ["glossary", "budget"])


@query("conversation_page", "SELECT DISTINCT message_id, sequence FROM history_messages WHERE conversation_id = (SELECT min(conversation_id) FROM history_messages) AND sequence > 2 ORDER BY sequence, message_id LIMIT 10")
def conversation_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of one conversation after a sequence number (a keyset read)."""
    m = table(spark, d, "history_messages")
    first = m.agg(F.min("conversation_id").alias("c"))
    return m.join(F.broadcast(first), F.col("conversation_id") == F.col("c")).where("sequence > 2").select("message_id", "sequence").distinct().orderBy("sequence", "message_id").limit(10)


@query("truncated", "SELECT conversation_id, count(DISTINCT message_id) AS kept FROM history_messages WHERE sequence < 5 GROUP BY conversation_id")
def truncated(spark: SparkSession, d: str) -> DataFrame:
    """Conversations cut before their fifth message."""
    return table(spark, d, "history_messages").where("sequence < 5").groupBy("conversation_id").agg(F.countDistinct("message_id").alias("kept"))


@query("forked", "SELECT 'fork-' || conversation_id AS conversation_id, count(*) AS copied FROM (SELECT DISTINCT conversation_id, message_id, sequence FROM history_messages WHERE sequence <= 3) GROUP BY conversation_id")
def forked(spark: SparkSession, d: str) -> DataFrame:
    """Forks that copy the first three messages of each conversation."""
    m = table(spark, d, "history_messages").where("sequence <= 3").select("conversation_id", "message_id", "sequence").distinct()
    return m.groupBy(F.concat(F.lit("fork-"), "conversation_id").alias("conversation_id")).agg(F.count(F.lit(1)).alias("copied"))


@query("history_index_check", "WITH i AS (SELECT DISTINCT message_id FROM history_messages WHERE sequence IS NOT NULL), m AS (SELECT DISTINCT message_id FROM history_messages WHERE content IS NOT NULL) SELECT (SELECT count(*) FROM m ANTI JOIN i USING (message_id)) AS missing, (SELECT count(*) FROM i ANTI JOIN m USING (message_id)) AS orphaned, (SELECT count(*) FROM m) AS messages")
def history_index_check(spark: SparkSession, d: str) -> DataFrame:
    """Messages without index rows and index rows without messages: one full join and one aggregate."""
    h = table(spark, d, "history_messages").where("message_id IS NOT NULL")
    g = h.groupBy("message_id").agg(F.bool_or(F.col("sequence").isNotNull()).alias("i"), F.bool_or(F.col("content").isNotNull()).alias("m"))
    return g.agg(F.count_if(F.col("m") & ~F.col("i")).alias("missing"), F.count_if(F.col("i") & ~F.col("m")).alias("orphaned"), F.count_if("m").alias("messages"))


@query("memory_sections", """WITH m AS (SELECT DISTINCT category, id, length(statement) AS n, coalesce(user_pinned, 0) AS p, updated_at AS u FROM memories WHERE status = 'active' AND id IS NOT NULL AND statement IS NOT NULL),
    o AS (SELECT *, sum(n) OVER (PARTITION BY category ORDER BY p DESC, u DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT category, count(*) FILTER (s <= 2000) AS shown, count(*) FILTER (s > 2000) AS more FROM o GROUP BY category""")
def memory_sections(spark: SparkSession, d: str) -> DataFrame:
    """Per category the memories that fit 2,000 characters, pinned and newest first, and how many do not."""
    m = table(spark, d, "memories").where("status = 'active' AND id IS NOT NULL AND statement IS NOT NULL").select("category", "id", F.length("statement").alias("n"), F.coalesce("user_pinned", F.lit(0)).alias("p"), F.col("updated_at").alias("u")).distinct()
    w = Window.partitionBy("category").orderBy(F.desc("p"), F.desc_nulls_last("u"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("s", F.sum("n").over(w)).groupBy("category").agg(F.count_if(F.col("s") <= 2000).alias("shown"), F.count_if(F.col("s") > 2000).alias("more"))


@query("slice_containment", """WITH v AS (SELECT block_id, 0 AS a, any_value(length(text)) AS b, 0 AS n FROM blocks WHERE text IS NOT NULL AND block_id IS NOT NULL GROUP BY block_id UNION ALL SELECT block_id, x * 300, least((x + 1) * 300, len), x + 1 FROM (SELECT block_id, any_value(length(text)) AS len, unnest(generate_series(0, (any_value(length(text)) - 1) // 300)) AS x FROM blocks WHERE length(text) > 0 AND block_id IS NOT NULL GROUP BY block_id))
    SELECT o.block_id, count(*) AS inside FROM v o JOIN v i ON o.block_id = i.block_id AND o.n <> i.n AND o.a <= i.a AND i.b <= o.b AND (o.b - o.a > i.b - i.a) GROUP BY o.block_id""")
def slice_containment(spark: SparkSession, d: str) -> DataFrame:
    """How many of a block's 300-character slices lie within the whole (an equality on the block, a range on the span)."""
    b = table(spark, d, "blocks").where("length(text) > 0 AND block_id IS NOT NULL").groupBy("block_id").agg(F.first(F.length("text")).alias("n"))
    i = b.select("block_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 300).cast("int"))).alias("x")).select("block_id", (F.col("x") * 300).alias("a"), F.least(F.col("x") * 300 + 300, "n").alias("b"))
    o = b.select("block_id", F.lit(0).alias("oa"), F.col("n").alias("ob"))
    return o.join(i, "block_id").where("oa <= a AND b <= ob AND ob - oa > b - a").groupBy("block_id").agg(F.count(F.lit(1)).alias("inside"))


@query("web_budget", "WITH u AS (SELECT user_id, 'https://h' || (event_id % 50) || '.example/' AS url, event_id FROM events), f AS (SELECT user_id, url, min(event_id) AS first FROM u GROUP BY ALL) SELECT user_id, url FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY first) <= 5")
def web_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first five different addresses of every user (the budget is the feature)."""
    raw = F.concat(F.lit("HTTPS://H"), F.expr("event_id % 50").cast("string"), F.lit(".example?utm_id=1"))
    f = table(spark, d, "events").select("user_id", T.web_url(raw).alias("url"), "event_id").groupBy("user_id", "url").agg(F.min("event_id").alias("first"))
    return f.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("first"))).where("n <= 5").select("user_id", "url")


@query("task_layers", "WITH RECURSIVE t AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey >= 3 THEN n_nationkey // 3 END AS parent FROM nation), l AS (SELECT id, 0 AS layer FROM t WHERE parent IS NULL UNION ALL SELECT t.id, l.layer + 1 FROM t JOIN l ON t.parent = l.id) SELECT id, layer FROM l")
def task_layers(spark: SparkSession, d: str) -> DataFrame:
    """Tasks in the order they become ready: layers of a dependency graph (nation keys, each depending on a third of itself)."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return graph.layers(spark, n, n.where("id >= 3").select("id", F.floor(F.col("id") / 3).alias("needs")))


@query("answer_numbers", """WITH m AS (SELECT DISTINCT message_id, content FROM conversation_messages WHERE message_id IS NOT NULL AND content IS NOT NULL), n AS (SELECT DISTINCT message_id, content, unnest(regexp_extract_all(content, '[0-9]+')) AS num FROM m)
    SELECT message_id, count(DISTINCT num) AS numbers FROM n GROUP BY message_id""")
def answer_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The different numbers each answer states (the left side of the support check)."""
    m = table(spark, d, "conversation_messages").where("message_id IS NOT NULL AND content IS NOT NULL").select("message_id", "content").distinct()
    return m.select("message_id", F.explode(F.regexp_extract_all("content", F.lit("([0-9]+)"), 1)).alias("num")).groupBy("message_id").agg(F.countDistinct("num").alias("numbers"))


@query("unsupported_numbers", """WITH a AS (SELECT id, unnest(regexp_extract_all(array_to_string(answer_points, ' '), '[0-9]+')) AS num FROM eval_questions), e AS (SELECT id, ' ' || string_agg(s, ' ') || ' ' AS t FROM (SELECT id, unnest(evidence).snippet AS s FROM eval_questions) GROUP BY id)
    SELECT DISTINCT a.id, a.num FROM a LEFT JOIN (SELECT DISTINCT id, unnest(regexp_extract_all(t, '[0-9]+')) AS num FROM e) x ON a.id = x.id AND a.num = x.num WHERE x.num IS NULL""")
def unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the answer points that no evidence snippet of the item states."""
    q = table(spark, d, "eval_questions")
    nums = lambda c: F.regexp_extract_all(c, F.lit("([0-9]+)"), 1)
    a = q.select("id", F.explode(nums(F.array_join("answer_points", " "))).alias("num")).distinct()
    e = q.select("id", F.explode("evidence.snippet").alias("s")).select("id", F.explode(nums(F.col("s"))).alias("num")).distinct()
    return a.join(e, ["id", "num"], "left_anti")


@query("image_status", "SELECT CASE WHEN d.content_hash IS NULL THEN 'pending' ELSE 'described' END AS status, count(*) AS images FROM (SELECT DISTINCT image_content_hash AS h FROM blocks WHERE image_content_hash IS NOT NULL) b LEFT JOIN (SELECT DISTINCT content_hash FROM image_descriptions) d ON b.h = d.content_hash GROUP BY 1")
def image_status(spark: SparkSession, d: str) -> DataFrame:
    """Images that have a description and those whose description is pending."""
    b = table(spark, d, "blocks").where("image_content_hash IS NOT NULL").select(F.col("image_content_hash").alias("content_hash")).distinct()
    i = table(spark, d, "image_descriptions").select("content_hash").distinct().withColumn("there", F.lit(True))
    return b.join(i, "content_hash", "left").groupBy(F.when(F.col("there"), "described").otherwise("pending").alias("status")).agg(F.count(F.lit(1)).alias("images"))


@query("source_parts", "SELECT doc_id, list_last(string_split(path, '/')) AS name, CASE WHEN len(string_split(path, '/')) > 1 THEN string_split(path, '/')[-2] END AS topic FROM documents WHERE path IS NOT NULL")
def source_parts(spark: SparkSession, d: str) -> DataFrame:
    """What of a path may be shown: the file's name and its folder."""
    parts = F.split("path", "/")
    return table(spark, d, "documents").where("path IS NOT NULL").select("doc_id", F.element_at(parts, -1).alias("name"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("topic"))


@query("heading_labels", "SELECT list_last(string_split(heading_path, ' > ')) AS label, count(DISTINCT doc_id) AS documents, count(DISTINCT heading_path) AS paths FROM blocks WHERE coalesce(heading_path, '') <> '' GROUP BY 1")
def heading_labels(spark: SparkSession, d: str) -> DataFrame:
    """Leaf headings with the documents and paths that use them."""
    b = table(spark, d, "blocks").where("coalesce(heading_path, '') <> ''")
    return b.groupBy(F.element_at(T.heading_parts(F.col("heading_path")), -1).alias("label")).agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("heading_path").alias("paths"))


@query("alias_lists", "SELECT block_id, coalesce(len(from_json(heading_aliases, '[\"VARCHAR\"]')), 0) AS aliases FROM (SELECT DISTINCT block_id, CASE WHEN json_valid(heading_aliases) THEN heading_aliases END AS heading_aliases FROM blocks)")
def alias_lists(spark: SparkSession, d: str) -> DataFrame:
    """Heading aliases parsed from JSON; what does not parse has none."""
    b = table(spark, d, "blocks").select("block_id", "heading_aliases").distinct()
    return b.select("block_id", F.greatest(F.coalesce(F.size(F.from_json("heading_aliases", "array<string>")), F.lit(0)), F.lit(0)).alias("aliases"))


@query("history_days", "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(DISTINCT message_id) AS messages FROM history_messages WHERE created_at >= TIMESTAMP '2024-06-01' AND created_at < TIMESTAMP '2025-01-01' GROUP BY 1")
def history_days(spark: SparkSession, d: str) -> DataFrame:
    """Messages per day in a range whose last day is included (a range on the stored column, so it is pushed down)."""
    h = table(spark, d, "history_messages").where("created_at >= TIMESTAMP_NTZ '2024-06-01' AND created_at < TIMESTAMP_NTZ '2025-01-01'")
    return h.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("message_id").alias("messages"))
