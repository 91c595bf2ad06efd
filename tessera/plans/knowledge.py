"""Queries: ingestion, evidence, evaluation, streaming, and an engine smoke test on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.embed import embedding
from tessera.functions.vectors import cosine
from tessera.operators import dense, evaluate, evidence, lexical, markdown
from tessera.plans import search as S
from tessera.plans.catalog import query
from tessera.streaming import event_log
from tessera.tables import table

# ---- ingestion


@query("chunk_documents")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document parsed and chunked (a parser: no SQL; tested by invariants)."""
    return markdown.chunk_documents(table(spark, d, "documents"))


@query("chunk_kinds")
def chunk_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = markdown.chunk_documents(table(spark, d, "documents"))
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.max(F.length("chunk")).alias("longest"))


@query("html_to_blocks")
def html_to_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of the documents (script, table and image around each text), brought to Markdown and chunked."""
    page = F.concat(F.lit("<html><head><style>p{}</style><script>var x=1;</script></head><body><h1>Page "), F.col("doc_id").cast("string"), F.lit("</h1><table><tr><th>k</th><th>v</th></tr><tr><td>id</td><td>"), F.col("doc_id").cast("string"), F.lit("</td></tr></table><p>"), F.replace(F.replace(F.col("text"), F.lit("<"), F.lit("&lt;")), F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p><!-- x --></body></html>"))
    return markdown.chunk_documents(table(spark, d, "documents").select("doc_id", page.alias("text")), html=True)


@query("chunk_length_stats", """WITH b AS (SELECT block_id, any_value(chunk_type) AS chunk_type, length(any_value(text)) AS n, md5(any_value(text)) AS h FROM blocks WHERE text IS NOT NULL AND block_id IS NOT NULL GROUP BY block_id)
    SELECT chunk_type, count(*) AS chunks, round(avg(n), 4) AS mean, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.9) AS p90, max(n) AS longest, round(100.0 * count(*) FILTER (n < 50) / count(*), 4) AS under_50, round(100.0 * count(*) FILTER (n < 150) / count(*), 4) AS under_150, count(*) - count(DISTINCT h) AS repeated, count(*) FILTER (n = 2000) AS at_ceiling FROM b GROUP BY chunk_type""")
def chunk_length_stats(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("text IS NOT NULL AND block_id IS NOT NULL").groupBy("block_id").agg(F.first("chunk_type").alias("chunk_type"), F.first(F.length("text")).alias("n"), F.first(F.md5(F.col("text").cast("binary"))).alias("h"))
    return b.groupBy("chunk_type").agg(
        F.count(F.lit(1)).alias("chunks"), F.round(F.avg("n"), 4).alias("mean"), F.percentile("n", 0.5).alias("median"), F.percentile("n", 0.9).alias("p90"), F.max("n").alias("longest"),
        F.round(F.count_if(F.col("n") < 50) * 100.0 / F.count(F.lit(1)), 4).alias("under_50"), F.round(F.count_if(F.col("n") < 150) * 100.0 / F.count(F.lit(1)), 4).alias("under_150"),
        (F.count(F.lit(1)) - F.countDistinct("h")).alias("repeated"), F.count_if(F.col("n") == 2000).alias("at_ceiling"),
    )


@query("embed_descriptions")
def embed_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct picture description embedded once (deterministic embedder; checked by a test)."""
    return table(spark, d, "image_descriptions").select("content_hash", "description").distinct().select("content_hash", F.md5(F.col("description").cast("binary")).alias("h"), embedding("description").alias("vector"))


@query("semantic_breaks")
def semantic_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Where unheaded documents of 800 characters or more change their subject: neighbouring paragraphs under a cosine of 0.30."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull() & (F.length("text") >= 800) & ~F.col("text").rlike(r"(?m)^#{1,6}\s"))
    p = docs.select("doc_id", F.posexplode(F.filter(F.split("text", r"\n\s*\n"), lambda x: F.trim(x) != "")).alias("n", "paragraph"))
    e = p.select("doc_id", "n", embedding("paragraph").alias("v"))
    w = Window.partitionBy("doc_id").orderBy("n")
    e = e.withColumn("sim", F.round(cosine(F.lag("v").over(w), F.col("v")), 6))
    return e.select("doc_id", "n", "sim", F.sum((F.coalesce(F.col("sim"), F.lit(1.0)) < 0.30).cast("int")).over(w).alias("part"))


@query("line_noise", r"""WITH l AS (SELECT trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
    SELECT regexp_full_match(line, '(?:#[\w/-]+\s*)+') OR regexp_full_match(line, '(?:https?://\S+\s*)+') OR regexp_full_match(line, '[^\p{L}\p{N}\p{M}]*') AS noise, count(*) AS lines FROM l WHERE regexp_full_match(line, '[\x20-\x7E]*') GROUP BY 1""")
def line_noise(spark: SparkSession, d: str) -> DataFrame:
    """ASCII lines that hold no knowledge (tags, addresses, punctuation) and the others, as its SQL has them; all lines are
    counted by line_noise_all."""
    return markdown.line_noise(table(spark, d, "documents"), F.col("line").rlike(r"^[\x20-\x7E]*$"))


@query("line_noise_all")
def line_noise_all(spark: SparkSession, d: str) -> DataFrame:
    """The same over every line, of whatever script (DuckDB's classes differ: no SQL; tested against brute force)."""
    return markdown.line_noise(table(spark, d, "documents"))


@query("embedding_text", "SELECT block_id, md5(array_to_string(list_filter([CASE WHEN coalesce(s, '') <> '' THEN '文档：' || s END, CASE WHEN coalesce(heading_path, '') <> '' THEN '标题：' || heading_path END, CASE WHEN coalesce(text, '') <> '' THEN '内容：' || text END], lambda x: x IS NOT NULL), chr(10))) AS h FROM (SELECT *, regexp_replace(regexp_extract(source_file, '([^/]*)$', 1), '\\.[^.]*$', '') AS s FROM blocks)".replace("\\\\", "\\"))
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").select("block_id", F.md5(T.embedding_text(F.col("source_file"), F.col("heading_path"), F.col("text")).cast("binary")).alias("h"))


@query("image_cache", "SELECT image_path, arg_min(b.content_hash, row(created_at, b.content_hash)) AS content_hash FROM (SELECT DISTINCT image_path, image_content_hash FROM blocks WHERE image_path IS NOT NULL) i JOIN image_descriptions b ON i.image_content_hash = b.content_hash WHERE b.created_at IS NOT NULL GROUP BY image_path")
def image_cache(spark: SparkSession, d: str) -> DataFrame:
    """The earliest description of each image path, over all retained ones."""
    i = table(spark, d, "blocks").where("image_path IS NOT NULL").select("image_path", F.col("image_content_hash").alias("content_hash")).distinct()
    return i.join(table(spark, d, "image_descriptions").where("created_at IS NOT NULL"), "content_hash").groupBy("image_path").agg(F.min(F.struct("created_at", "content_hash")).alias("f")).select("image_path", "f.content_hash")


# ---- evidence


@query("evidence_views")
def evidence_views(spark: SparkSession, d: str) -> DataFrame:
    return evidence.views(table(spark, d, "blocks"))


@query("select_budget")
def select_budget(spark: SparkSession, d: str) -> DataFrame:
    """Views of the lexical hits of every question, scored by coverage, selected under quota and budget (order-dependent)."""
    b = table(spark, d, "blocks")
    once = b.where("block_id IS NOT NULL").groupBy("block_id").agg(F.min("text").alias("text"))
    hits = lexical.search(once, "block_id", "text", S.questions(spark, d), "query_id", "question", 50)
    v = evidence.views(b)
    scored = hits.join(v, "block_id").select("query_id", "view_id", "block_id", "start", "stop", F.col("coverage").alias("score"), F.col("rank").alias("rrf_rank"))
    return evidence.select_budget(scored, 0.15)


CLAIM_SQL = evidence.CLAIM.replace("'", "''")


@query("numeric_conflicts", f"""WITH s AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[。！？\\n]')) AS s FROM blocks),
    c AS (SELECT DISTINCT doc_id AS source, trim(regexp_replace(regexp_replace(s, '{CLAIM_SQL}', '{{value}}'), '\\s+', ' ', 'g')) AS template, regexp_extract(s, '{CLAIM_SQL}', 1) AS value, lower(regexp_extract(s, '{CLAIM_SQL}', 2)) AS unit FROM s WHERE len(regexp_extract_all(s, '{CLAIM_SQL}')) = 1)
    SELECT template, unit, count(DISTINCT value) AS numbers, count(DISTINCT source) AS sources FROM c WHERE regexp_matches(replace(template, '{{value}}', ''), '[a-zA-Z一-鿿]') GROUP BY template, unit HAVING count(DISTINCT value) >= 2 AND count(DISTINCT source) >= 2""")
def numeric_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.numeric_conflicts(table(spark, d, "blocks").select(F.col("doc_id").alias("source"), "text"))


@query("evidence_merge", "SELECT 'ev-' || substring(sha256(array_to_string(list_filter([source_type, block_id, sha256(coalesce(text, ''))], lambda x: x IS NOT NULL), chr(31))), 1, 24) AS evidence_id, count(*) AS copies, min(source_type) AS source_type, min(block_id) AS source_ref FROM blocks GROUP BY 1")
def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").select("source_type", F.col("block_id").alias("source_ref"), F.col("text").alias("content"))
    return evidence.merge(b)


@query("citations", """WITH m AS (SELECT DISTINCT conversation_id, message_id, created_at, sources FROM conversation_messages WHERE message_id IS NOT NULL AND json_valid(sources)),
    s AS (SELECT conversation_id, message_id, coalesce(created_at, '') AS "at", unnest(from_json(sources, '["JSON"]')) AS src, generate_subscripts(from_json(sources, '["JSON"]'), 1) AS n FROM m),
    f AS (SELECT conversation_id, src::VARCHAR AS src, min(row("at", message_id, n)) AS first FROM s GROUP BY ALL)
    SELECT conversation_id, count(*) AS sources, max(label) AS labels FROM (SELECT *, dense_rank() OVER (PARTITION BY conversation_id ORDER BY first) AS label FROM f) GROUP BY conversation_id""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the sources of each conversation, numbered by first use."""
    m = table(spark, d, "conversation_messages").where(F.col("message_id").isNotNull() & F.try_parse_json("sources").isNotNull()).select("conversation_id", "message_id", "created_at", "sources").distinct()
    s = m.select("conversation_id", F.coalesce("created_at", F.lit("")).alias("at"), "message_id", F.posexplode(F.from_json("sources", "array<string>")).alias("n", "src"))
    f = s.groupBy("conversation_id", "src").agg(F.min(F.struct("at", "message_id", "n")).alias("first"))
    f = f.withColumn("label", F.dense_rank().over(Window.partitionBy("conversation_id").orderBy("first")))
    return f.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("sources"), F.max("label").alias("labels"))


@query("answer_basis", "SELECT conversation_id, array_to_string(list_sort(list(DISTINCT answer_basis)), '+') AS basis, count(DISTINCT message_id) AS messages FROM conversation_messages WHERE coalesce(answer_basis, '') <> '' GROUP BY conversation_id")
def answer_basis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversation_messages").where("coalesce(answer_basis, '') <> ''").groupBy("conversation_id").agg(F.array_join(F.array_sort(F.collect_set("answer_basis")), "+").alias("basis"), F.countDistinct("message_id").alias("messages"))


@query("support_check", f"""WITH q AS (SELECT id AS query_id, list_distinct({T.tokens_sql('question')}) AS terms FROM eval_questions), e AS (SELECT id AS query_id, unnest(evidence).snippet AS snippet FROM eval_questions)
    SELECT query_id, count(*) AS snippets, sum(CASE WHEN k >= 3 OR k >= 0.2 * n THEN 1 ELSE 0 END)::BIGINT AS supporting FROM (SELECT query_id, len(terms) AS n, len(list_filter(terms, lambda t: contains(lower(snippet), t))) AS k FROM e JOIN q USING (query_id)) GROUP BY query_id""")
def support_check(spark: SparkSession, d: str) -> DataFrame:
    """Snippets that hold enough of their question's terms (three, or a fifth)."""
    q = table(spark, d, "eval_questions").select(F.col("id").alias("query_id"), F.array_distinct(T.tokens(F.col("question"))).alias("terms"), F.explode("evidence").alias("e"))
    k = F.size(F.filter("terms", lambda t: F.contains(F.lower(F.col("e.snippet")), t)))
    return q.groupBy("query_id").agg(F.count(F.lit(1)).alias("snippets"), F.sum(((k >= 3) | (k >= 0.2 * F.size("terms"))).cast("long")).alias("supporting"))


@query("redacted_sources", "SELECT doc_id, replace(replace(replace(path, 'obsidian_vault', 'S1'), 'course_notes', 'S2'), 'journal', 'S3') AS path FROM documents")
def redacted_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.redacted(F.col("path"), {"journal": "S3", "obsidian_vault": "S1", "course_notes": "S2"}).alias("path"))


# ---- evaluation

POINTS = """tg AS (SELECT DISTINCT q.query_id, d.doc_id FROM (SELECT id AS query_id, unnest(evidence).snippet AS s FROM eval_questions) q JOIN documents d ON contains(d.text, q.s))"""
JUDGED = f"""WITH {S.DOC_TOKENS}, {S.STATS}, {S.POSTINGS}, {S.QUERIES_SQL}, {S.SCORED}, {POINTS},
w AS (SELECT query_id, count(*) AS n FROM tg GROUP BY query_id),
j AS (SELECT r.query_id, r.k, r.rank, tg.doc_id IS NOT NULL AS rel FROM r LEFT JOIN tg ON r.query_id = tg.query_id AND r.k = tg.doc_id WHERE rank <= 8),
m AS (SELECT w.query_id, coalesce(min(rank) FILTER (rel), 0) AS f, coalesce(sum(CASE WHEN rel THEN 1 / log2(rank + 1.0) ELSE 0 END), 0) / list_sum(list_transform(generate_series(1, least(any_value(n), 8)), lambda i: 1 / log2(i + 1.0))) AS ndcg FROM w LEFT JOIN j USING (query_id) GROUP BY w.query_id)"""


def per_question(spark: SparkSession, d: str) -> DataFrame:
    """Measures per question; targets are the documents that hold one of its evidence snippets verbatim."""
    docs, qs = table(spark, d, "documents"), table(spark, d, "eval_questions")
    sn = qs.select(F.col("id").alias("query_id"), F.explode("evidence.snippet").alias("s"))
    targets = evaluate.containing(docs, "doc_id", "text", sn, "query_id", "s").select("query_id", F.col("doc_id").alias("key"))
    hits = lexical.search(docs, "doc_id", "text", S.questions(spark, d), "query_id", "question", 8).select("query_id", F.col("doc_id").alias("key"), "rank")
    wanted = targets.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return evaluate.per_query(evaluate.judged(hits, targets), wanted, 8)


@query("hit_mrr", f"{JUDGED} SELECT count(*) AS queries, round(avg((f = 1)::INT), 6) AS hit1, round(avg((f BETWEEN 1 AND 5)::INT), 6) AS hit5, round(avg((f BETWEEN 1 AND 8)::INT), 6) AS hit8, round(avg(CASE WHEN f > 0 THEN 1 / f ELSE 0 END), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m")
def hit_mrr(spark: SparkSession, d: str) -> DataFrame:
    m = per_question(spark, d)
    return m.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(a), 6).alias(b) for a, b in (("hit1", "hit1"), ("hit5", "hit5"), ("hitk", "hit8"), ("rr", "mrr"), ("ndcg", "ndcg"))])


@query("graded_metrics", f"{JUDGED} SELECT e.type, count(*) AS queries, round(avg((f BETWEEN 1 AND 8)::INT), 6) AS hit8, round(avg(ndcg), 6) AS ndcg FROM m JOIN eval_questions e ON e.id = m.query_id GROUP BY GROUPING SETS ((), (e.type))")
def graded_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Overall and by type of question in one pass (grouping sets)."""
    m = per_question(spark, d).join(table(spark, d, "eval_questions").select(F.col("id").alias("query_id"), "type"), "query_id")
    return m.rollup("type").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("hitk"), 6).alias("hit8"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query("eval_dataset_check", "SELECT count(*) AS items, count(DISTINCT id) AS ids, count(*) FILTER (answerable AND len(evidence) = 0) AS without_evidence, count(*) FILTER (NOT answerable AND len(evidence) > 0) AS negative_with_evidence FROM eval_questions")
def eval_dataset_check(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_questions")
    return q.agg(F.count(F.lit(1)).alias("items"), F.countDistinct("id").alias("ids"), F.count_if(F.col("answerable") & (F.size("evidence") == 0)).alias("without_evidence"), F.count_if(~F.col("answerable") & (F.size("evidence") > 0)).alias("negative_with_evidence"))


@query("corpus_snapshot", "SELECT sha256(string_agg(k, chr(10) ORDER BY k)) AS revision, count(*) AS buckets FROM (SELECT substring(sha256(block_id), 1, 2) AS b, substring(sha256(block_id), 1, 2) || ':' || sha256(string_agg(DISTINCT block_id, chr(10) ORDER BY block_id)) AS k FROM blocks WHERE block_id IS NOT NULL GROUP BY 1)")
def corpus_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The identity of the indexed corpus: a hash over the hashes of 256 buckets of sorted ids (two levels, so no task holds all ids)."""
    ids = table(spark, d, "blocks").where("block_id IS NOT NULL").select("block_id").distinct().withColumn("b", F.substring(F.sha2("block_id", 256), 1, 2))
    k = ids.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("block_id")), "\n"), 256).alias("h")).select(F.concat("b", F.lit(":"), "h").alias("k"))
    return k.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("revision"), F.count(F.lit(1)).alias("buckets"))


# ---- streaming


@query("event_log_stream", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_seq FROM events")
def event_log_stream(spark: SparkSession, d: str) -> DataFrame:
    """The event log as a stream with state: gap-free numbers per user."""
    events = event_log.read_table(spark, f"{d}/events.parquet").select("user_id", "event_id", "ts")
    return event_log.run(spark, event_log.numbered(events, "user_id", "long", "event_id", "long", "ts"), "numbered")


@query("event_once_stream", "SELECT event_id, event_type FROM events")
def event_once_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every event delivered twice, kept once; ids are held for as long as deliveries may be apart (two days)."""
    e = event_log.read_table(spark, f"{d}/events.parquet").select("event_id", "event_type", "ts")
    again = event_log.read_table(spark, f"{d}/events.parquet").select("event_id", "event_type", "ts")
    return event_log.run(spark, event_log.once(e.unionByName(again), "event_id", "ts", "2 days"), "once").select("event_id", "event_type")


# ---- engine smoke test on the star schema


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
