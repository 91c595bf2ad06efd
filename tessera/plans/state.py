"""Queries: documents and their synchronisation, catalog, history, memories, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import catalog as C
from tessera.operators import store, sync
from tessera.plans.catalog import query
from tessera.tables import table


# ---- documents and synchronisation

CANON_DOC = """SELECT content_hash, arg_min(path, row(len(list_filter(string_split(path, '/'), lambda x: regexp_full_match(x, '[0-9a-fA-F]{32}'))), len(string_split(path, '/')), length(path), lower(path), path)) AS path FROM documents WHERE content_hash IS NOT NULL AND path IS NOT NULL GROUP BY content_hash"""


@query("canonical_docs", f"{CANON_DOC}")
def canonical_docs(spark: SparkSession, d: str) -> DataFrame:
    """The path that stands for each content."""
    return sync.canonical_paths(table(spark, d, "documents"))


@query("duplicate_groups", "SELECT content_hash, count(*) AS copies, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("copies > 1")


#: Two snapshots of the documents by a fixed rule: some paths are new, some gone, some touched, some edited.
def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").where("path IS NOT NULL").select("doc_id", "path", "content_hash", "mtime", "size")
    once = docs.groupBy("path").agg(F.min(F.struct("doc_id", "content_hash", "mtime", "size")).alias("r")).select("path", "r.*")
    before = once.where("doc_id % 11 <> 0").select("path", "content_hash", "mtime", "size")
    now = once.where("doc_id % 13 <> 0").select("path", F.when(F.expr("doc_id % 7 = 0"), F.concat(F.lit("x"), "content_hash")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.expr("doc_id % 5 = 0 OR doc_id % 7 = 0"), F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), "size")
    return before, now


SNAPSHOTS = """o AS (SELECT path, arg_min(row(doc_id, content_hash, mtime, size), doc_id) AS r FROM documents WHERE path IS NOT NULL GROUP BY path),
once AS (SELECT path, r[1] AS doc_id, r[2] AS content_hash, r[3] AS mtime, r[4] AS size FROM o),
before AS (SELECT path, content_hash, mtime, size FROM once WHERE doc_id % 11 <> 0),
now AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'x' || content_hash ELSE content_hash END AS content_hash, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN mtime + 1 ELSE mtime END AS mtime, size FROM once WHERE doc_id % 13 <> 0)"""
DIFF = f"""{SNAPSHOTS},
c AS (SELECT content_hash, arg_min(path, row(len(list_filter(string_split(path, '/'), lambda x: regexp_full_match(x, '[0-9a-fA-F]{{32}}'))), len(string_split(path, '/')), length(path), lower(path), path)) AS canonical FROM now GROUP BY content_hash),
diff AS (SELECT coalesce(b.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN c.canonical <> n.path THEN 'duplicate' WHEN b.path IS NULL THEN 'added'
  WHEN b.mtime = n.mtime AND b.size = n.size THEN 'unchanged' WHEN b.content_hash = n.content_hash THEN 'touched' ELSE 'updated' END AS action
  FROM before b FULL JOIN now n ON b.path = n.path LEFT JOIN c ON n.content_hash = c.content_hash)"""


@query("sync_diff", f"WITH {DIFF} SELECT path, action FROM diff")
def sync_diff(spark: SparkSession, d: str) -> DataFrame:
    """What an incremental sync does with each path: time and size first, then the hash; further paths of a content are duplicates."""
    return sync.diff(*snapshots(spark, d))


@query("sync_report", f"WITH {DIFF} SELECT action, count(*) AS paths FROM diff GROUP BY action")
def sync_report(spark: SparkSession, d: str) -> DataFrame:
    return sync.diff(*snapshots(spark, d)).groupBy("action").agg(F.count(F.lit(1)).alias("paths"))


VERSIONS = """old AS (SELECT block_id, doc_id, md5(text) AS h, document_order AS o FROM (SELECT block_id, any_value(doc_id) AS doc_id, any_value(text) AS text, min(document_order) AS document_order FROM blocks WHERE text IS NOT NULL AND block_id IS NOT NULL GROUP BY block_id)),
new AS (SELECT block_id || '~' AS block_id, doc_id, CASE WHEN o % 5 = 2 THEN md5(h) ELSE h END AS h FROM old WHERE o % 9 <> 4 OR o IS NULL),
first_old AS (SELECT doc_id, h, min(block_id) AS reused FROM old GROUP BY doc_id, h)"""


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = table(spark, d, "blocks").where("text IS NOT NULL AND block_id IS NOT NULL").groupBy("block_id").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min("document_order").alias("o"))
    old = b.select("block_id", "doc_id", F.md5(F.col("text").cast("binary")).alias("h"), "o")
    new = old.where("o % 9 <> 4 OR o IS NULL").select(F.concat("block_id", F.lit("~")).alias("block_id"), "doc_id", F.when(F.expr("o % 5 = 2"), F.md5(F.col("h").cast("binary"))).otherwise(F.col("h")).alias("h"))
    return old.drop("o"), new


@query("block_reuse", f"WITH {VERSIONS}, m AS (SELECT n.block_id, reused, row_number() OVER (PARTITION BY n.doc_id, n.h ORDER BY n.block_id) AS k FROM new n LEFT JOIN first_old f ON n.doc_id = f.doc_id AND n.h = f.h) SELECT block_id, CASE WHEN k = 1 THEN reused END AS reused FROM m")
def block_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Which new blocks keep an old block's vector: equal text in the document, at most one match per text."""
    return sync.reuse(*versions(spark, d))


@query("stale_blocks", f"WITH {VERSIONS} SELECT o.block_id FROM old o ANTI JOIN (SELECT reused FROM first_old f JOIN new n ON n.doc_id = f.doc_id AND n.h = f.h) m ON o.block_id = m.reused")
def stale_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Old blocks whose vectors go: matched by no new block."""
    old, new = versions(spark, d)
    kept = sync.reuse(old, new).where("reused IS NOT NULL").select(F.col("reused").alias("block_id"))
    return old.select("block_id").join(kept, "block_id", "left_anti")


@query("requires_reindex", "SELECT doc_id, schema_version IS DISTINCT FROM m.v OR index_fingerprint IS DISTINCT FROM m.f AS requires_reindex FROM documents, (SELECT max(schema_version) AS v, max(index_fingerprint) AS f FROM documents) m")
def requires_reindex(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose schema version or index fingerprint is not the current one (the highest)."""
    docs = table(spark, d, "documents")
    now = docs.agg(F.max("schema_version").alias("v"), F.max("index_fingerprint").alias("f"))
    return docs.join(F.broadcast(now)).select("doc_id", (~F.col("schema_version").eqNullSafe(F.col("v")) | ~F.col("index_fingerprint").eqNullSafe(F.col("f"))).alias("requires_reindex"))


@query("needs_rebuild", "SELECT count(*) > 0 AND (coalesce(sum(chunk_count), 0) = 0 OR count(DISTINCT schema_version) > 1 OR count(DISTINCT index_fingerprint) > 1) AS needs_rebuild FROM documents")
def needs_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(((F.count(F.lit(1)) > 0) & ((F.coalesce(F.sum("chunk_count"), F.lit(0)) == 0) | (F.countDistinct("schema_version") > 1) | (F.countDistinct("index_fingerprint") > 1))).alias("needs_rebuild"))


@query("index_coverage", "WITH b AS (SELECT DISTINCT doc_id AS h FROM blocks WHERE source_type = 'document') SELECT CASE WHEN d.content_hash IS NULL THEN 'orphan' WHEN b.h IS NULL THEN 'missing' ELSE 'indexed' END AS state, count(*) AS contents FROM (SELECT DISTINCT content_hash FROM documents WHERE content_hash IS NOT NULL) d FULL JOIN b ON d.content_hash = b.h GROUP BY 1")
def index_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Contents that are indexed, missing from the index, or only in the index."""
    docs = table(spark, d, "documents").where("content_hash IS NOT NULL").select("content_hash").distinct()
    b = table(spark, d, "blocks").where("source_type = 'document'").select(F.col("doc_id").alias("h")).distinct()
    state = F.when(F.col("content_hash").isNull(), "orphan").when(F.col("h").isNull(), "missing").otherwise("indexed")
    return docs.join(b, F.col("content_hash") == F.col("h"), "full_outer").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("contents"))


@query("keyed_upsert", "WITH n AS (SELECT id, max(updated_at) AS u FROM memories WHERE id IS NOT NULL GROUP BY id) SELECT id, count(*) AS versions, arg_max(coalesce(status, ''), row(m.updated_at, coalesce(m.status, ''))) AS status FROM memories m JOIN n USING (id) WHERE m.updated_at IS NOT DISTINCT FROM n.u GROUP BY id")
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An idempotent write by key: the latest version of each id stays."""
    m = table(spark, d, "memories").where("id IS NOT NULL")
    return store.latest(m, "id", "updated_at").groupBy("id").agg(F.count(F.lit(1)).alias("versions"), F.max(F.coalesce("status", F.lit(""))).alias("status"))


# ---- catalog


@query("overview_by_topic", "SELECT source AS topic, count(*) AS documents, sum(coalesce(chunk_count, 0)) AS chunks FROM documents GROUP BY source ORDER BY documents DESC, topic NULLS LAST LIMIT 12")
def overview_by_topic(spark: SparkSession, d: str) -> DataFrame:
    """The twelve largest topics (a top-k report)."""
    return table(spark, d, "documents").groupBy(F.col("source").alias("topic")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("chunk_count", F.lit(0))).alias("chunks")).orderBy(F.desc("documents"), F.asc_nulls_last("topic")).limit(12)


@query("overview_counts", "SELECT count(*) AS blocks, count(DISTINCT source_file) AS files, count(DISTINCT doc_id) AS documents, count(*) FILTER (chunk_type = 'image_description') AS images, count(*) FILTER (source_type = 'conversation') AS messages FROM blocks")
def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("source_file").alias("files"), F.countDistinct("doc_id").alias("documents"), F.count_if(F.col("chunk_type") == "image_description").alias("images"), F.count_if(F.col("source_type") == "conversation").alias("messages"))


@query("catalog_build", """WITH b AS (SELECT doc_id, heading_path, min(document_order) AS o FROM blocks WHERE source_type = 'document' AND doc_id IS NOT NULL GROUP BY ALL),
    h AS (SELECT doc_id, list(heading_path ORDER BY o NULLS LAST, heading_path) AS hs FROM b WHERE coalesce(heading_path, '') <> '' GROUP BY doc_id),
    n AS (SELECT doc_id, count(DISTINCT block_id) AS blocks FROM blocks WHERE source_type = 'document' AND doc_id IS NOT NULL GROUP BY doc_id)
    SELECT doc_id, blocks, coalesce(len(hs), 0) AS headings, array_to_string(hs[1:64], '|') AS outline FROM n LEFT JOIN h USING (doc_id)""")
def catalog_build(spark: SparkSession, d: str) -> DataFrame:
    return C.outline(table(spark, d, "blocks").where("source_type = 'document'"))


CLUES = f"""e AS (SELECT DISTINCT doc_id, heading_path FROM blocks WHERE source_type = 'document' AND coalesce(heading_path, '') <> ''),
e1 AS (SELECT doc_id, heading_path, {T.catalog_text_sql("list_last(string_split(heading_path, ' > '))")} AS term, {T.catalog_text_sql('heading_path')} AS h FROM e),
q AS (SELECT id AS query_id, {T.catalog_text_sql('question')} AS q FROM eval_questions),
t AS (SELECT DISTINCT term, h FROM e1)"""


@query("catalog_search", f"""WITH {CLUES}, m AS (SELECT query_id, t.h, CASE WHEN term = q THEN 1000 WHEN length(term) >= 4 AND contains(q, term) THEN 800 WHEN contains(q, h) OR contains(h, q) THEN 400 ELSE 0 END AS score FROM q, t)
    SELECT query_id, score, count(DISTINCT doc_id || chr(31) || heading_path) AS entries FROM m JOIN e1 ON e1.h = m.h WHERE score > 0 GROUP BY ALL""")
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    """Headings that a question names: equal, contained label, contained path. Scored on distinct headings, joined back."""
    return C.search(table(spark, d, "blocks"), table(spark, d, "eval_questions"))


@query("url_normalize", "SELECT doc_id, 'https://host-' || (doc_id % 7) || '.example/a/b-' || doc_id || '?q=' || doc_id AS url FROM documents")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Addresses built from ids with upper-case hosts, double slashes, tracking parameters and fragments, brought to one form."""
    raw = F.concat(F.lit("HTTPS://Host-"), F.expr("doc_id % 7").cast("string"), F.lit(".EXAMPLE//a//b-"), F.col("doc_id").cast("string"), F.lit("/?utm_source=x&q="), F.col("doc_id").cast("string"), F.lit("&ref=y#part"))
    return table(spark, d, "documents").select("doc_id", T.web_url(raw).alias("url"))


@query("independent_domains", "SELECT event_type, count(DISTINCT 'h' || (user_id % 97) || '.example') AS domains FROM events GROUP BY event_type")
def independent_domains(spark: SparkSession, d: str) -> DataFrame:
    """Distinct hosts behind each event type (hosts derived from users)."""
    url = T.web_url(F.concat(F.lit("http://H"), F.expr("user_id % 97").cast("string"), F.lit(".Example/x?utm_medium=z")))
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct(F.try_parse_url(url, F.lit("HOST"))).alias("domains"))


@query("read_window", """WITH b AS (SELECT doc_id, block_id, any_value(heading_path) AS h, any_value(text) AS t, min(document_order) AS o FROM blocks WHERE source_type = 'document' AND doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id, block_id),
    p AS (SELECT *, length('章节：' || coalesce(h, '') || chr(10) || t) AS n FROM b),
    w AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY o NULLS LAST, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p)
    SELECT doc_id, block_id, start::BIGINT AS start, (start + n)::BIGINT AS stop FROM w WHERE start < 3000 AND start + n > 1000""")
def read_window(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that characters 1000 to 3000 of a document's reading text lie in, with their spans."""
    return C.read_window(table(spark, d, "blocks").where("source_type = 'document'"), 1000, 2000)


@query("document_outline", "SELECT doc_id, count(*) AS blocks, count(DISTINCT document_order) AS orders, count(*) FILTER (document_order IS NULL) AS unordered FROM (SELECT DISTINCT doc_id, block_id, document_order FROM blocks WHERE source_type = 'document') GROUP BY doc_id HAVING count(*) > count(DISTINCT document_order)")
def document_outline(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose block order is not unique or complete."""
    b = table(spark, d, "blocks").where("source_type = 'document'").select("doc_id", "block_id", "document_order").distinct()
    return b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("document_order").alias("orders"), F.count_if(F.col("document_order").isNull()).alias("unordered")).where("blocks > orders")


@query("short_context", """WITH b AS (SELECT block_id, any_value(doc_id) AS doc_id, any_value(heading_path) AS h, any_value(text) AS t, min(document_order) AS o, any_value(source_type) AS st FROM blocks WHERE text IS NOT NULL AND block_id IS NOT NULL GROUP BY block_id),
    s AS (SELECT * FROM b WHERE length(t) < 50 AND st = 'document' AND coalesce(h, '') <> '' AND o IS NOT NULL),
    n AS (SELECT s.block_id, s.t, x.t AS other, sum(length(x.t)) OVER (PARTITION BY s.block_id ORDER BY abs(x.o - s.o), x.o, x.block_id) - length(x.t) AS before FROM s JOIN b x ON s.doc_id = x.doc_id AND s.h = x.h AND s.block_id <> x.block_id AND x.o IS NOT NULL)
    SELECT block_id, least(600, any_value(length(t)) + sum(length(other)))::BIGINT AS context_chars, count(*) AS siblings FROM n WHERE length(t) + before < 120 GROUP BY block_id""")
def short_context(spark: SparkSession, d: str) -> DataFrame:
    """Blocks under fifty characters with the nearest siblings of their heading that bring them to 120 characters (600 at most)."""
    return C.short_context(table(spark, d, "blocks"))


@query("image_companion", """WITH b AS (SELECT block_id, any_value(source_file) AS s, any_value(heading_path) AS h, any_value(chunk_type) AS c, min(document_order) AS o FROM blocks WHERE block_id IS NOT NULL GROUP BY block_id)
    SELECT i.block_id, arg_min(t.block_id, row(coalesce(t.o, 1000000000), t.block_id)) AS companion FROM b i JOIN b t ON i.s = t.s AND i.h = t.h AND i.c = 'image_description' AND t.c = 'text' WHERE trim(i.h) <> '' GROUP BY i.block_id""")
def image_companion(spark: SparkSession, d: str) -> DataFrame:
    """For each image block the first text block under exactly its heading."""
    b = table(spark, d, "blocks").where("block_id IS NOT NULL").groupBy("block_id").agg(F.first("source_file").alias("s"), F.first("heading_path").alias("h"), F.first("chunk_type").alias("c"), F.min("document_order").alias("o"))
    first = b.where("c = 'text' AND trim(h) <> ''").groupBy("s", "h").agg(F.min(F.struct(F.coalesce("o", F.lit(1000000000)).alias("o"), "block_id")).alias("f"))
    return b.where("c = 'image_description'").join(first, ["s", "h"]).select("block_id", F.col("f.block_id").alias("companion"))


# ---- history


@query("history_distinct", """WITH m AS (SELECT message_id, min(conversation_id) AS c, min(lower(trim(role))) AS role, min(content) AS content, min(created_at) AS t, min(sequence) AS s FROM history_messages WHERE message_id IS NOT NULL GROUP BY message_id),
    k AS (SELECT *, CASE WHEN s = 1 AND role = 'user' AND length(content) >= 20 THEN '' ELSE message_id END AS own FROM m)
    SELECT message_id, c AS conversation_id FROM k QUALIFY row_number() OVER (PARTITION BY role, content, own ORDER BY t NULLS LAST, message_id) = 1""")
def history_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Messages once: long first user messages collapse across conversations, all others keep to themselves. Only the
    candidates for collapsing meet in a group, and the earliest is taken by partial aggregation, so no window over a hot text is needed."""
    return C.distinct_messages(table(spark, d, "history_messages"))


@query("conversation_counts", "SELECT conversation_id, count(DISTINCT message_id) AS messages, min(created_at) AS first_at, max(created_at) AS last_at, max(sequence) AS last_sequence FROM history_messages GROUP BY conversation_id")
def conversation_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "history_messages").groupBy("conversation_id").agg(F.countDistinct("message_id").alias("messages"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.max("sequence").alias("last_sequence"))


@query("history_search", f"""WITH p0 AS (SELECT DISTINCT message_id, conversation_id, content FROM history_messages WHERE message_id IS NOT NULL AND content IS NOT NULL), m AS (SELECT message_id, min(conversation_id) AS c, min(content) AS content FROM p0 GROUP BY message_id),
    t AS (SELECT DISTINCT message_id, c, term FROM (SELECT message_id, c, unnest({T.tokens_sql('content')}) AS term FROM m)),
    q AS (SELECT * FROM (VALUES (1, ['glossary', 'page']), (2, ['token', 'budget']), (3, ['标题', '重复']), (4, ['folder', 'scan'])) v(query_id, terms))
    SELECT query_id, message_id, any_value(c) AS conversation_id FROM (SELECT query_id, unnest(terms) AS term, len(terms) AS n FROM q) JOIN t USING (term) GROUP BY query_id, message_id HAVING count(DISTINCT term) = any_value(n)""")
def history_search(spark: SparkSession, d: str) -> DataFrame:
    """Messages that hold every term of a query."""
    q = spark.createDataFrame([(1, ["glossary", "page"]), (2, ["token", "budget"]), (3, ["标题", "重复"]), (4, ["folder", "scan"])], "query_id int, terms array<string>")
    return C.history_search(table(spark, d, "history_messages"), q)


@query("read_around", """WITH m AS (SELECT DISTINCT conversation_id, message_id, sequence FROM history_messages WHERE sequence IS NOT NULL AND message_id IS NOT NULL AND conversation_id IS NOT NULL)
    SELECT DISTINCT a.message_id AS center, b.message_id, b.sequence - a.sequence AS "offset" FROM m a JOIN m b ON a.conversation_id = b.conversation_id AND b.sequence BETWEEN a.sequence - 2 AND a.sequence + 1 WHERE a.sequence % 10 = 5""")
def read_around(spark: SparkSession, d: str) -> DataFrame:
    """Two messages before and one after every tenth message."""
    return C.read_around(table(spark, d, "history_messages"), F.expr("sequence % 10 = 5"), 2, 1)


@query("read_around_all", """WITH m AS (SELECT DISTINCT conversation_id, message_id, sequence FROM history_messages WHERE sequence IS NOT NULL AND message_id IS NOT NULL AND conversation_id IS NOT NULL)
    SELECT DISTINCT a.message_id AS center, b.message_id, b.sequence - a.sequence AS "offset" FROM m a JOIN m b ON a.conversation_id = b.conversation_id AND b.sequence BETWEEN a.sequence - 2 AND a.sequence + 1""")
def read_around_all(spark: SparkSession, d: str) -> DataFrame:
    """Two messages before and one after every numbered message."""
    return C.read_around(table(spark, d, "history_messages"), F.lit(True), 2, 1)


@query("orphan_memories", "SELECT id, source_conversation_id FROM memories m WHERE coalesce(source_conversation_id, '') <> '' AND NOT EXISTS (SELECT 1 FROM history_messages h WHERE h.conversation_id = m.source_conversation_id)")
def orphan_memories(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").where("coalesce(source_conversation_id, '') <> ''").select("id", "source_conversation_id")
    return m.join(table(spark, d, "history_messages").select(F.col("conversation_id").alias("source_conversation_id")).distinct(), "source_conversation_id", "left_anti").select("id", "source_conversation_id")


@query("next_sequence", "SELECT conversation_id, coalesce(max(sequence), 0) + 1 AS next_sequence FROM history_messages GROUP BY conversation_id")
def next_sequence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "history_messages").groupBy("conversation_id").agg((F.coalesce(F.max("sequence"), F.lit(0)) + 1).alias("next_sequence"))


# ---- memories


@query("memory_merge", """WITH m AS (SELECT *, trim(regexp_replace(lower(statement), '\\s+', ' ', 'g')) AS st FROM memories WHERE id IS NOT NULL AND statement IS NOT NULL)
    SELECT md5(coalesce(category, '') || chr(0) || st) AS content_key, count(DISTINCT id) AS ids, CASE WHEN bool_or(status = 'forgotten') THEN 'forgotten' WHEN max(coalesce(least(greatest(confidence, 0), 1), 0)) < 0.5 THEN 'pending' ELSE 'active' END AS status, max(coalesce(user_pinned, 0)) AS pinned FROM m GROUP BY 1""")
def memory_merge(spark: SparkSession, d: str) -> DataFrame:
    """Memories merged by category and statement: forgotten ones are never revived, weak ones wait."""
    return store.merge_memories(table(spark, d, "memories"))


@query("memory_list", "SELECT id, category, status FROM (SELECT id, category, status, max(updated_at) AS u FROM memories WHERE status IN ('active', 'pending') AND id IS NOT NULL GROUP BY id, category, status) ORDER BY u DESC NULLS LAST, id LIMIT 50")
def memory_list(spark: SparkSession, d: str) -> DataFrame:
    """The fifty newest retrievable memories (a page of a list)."""
    m = table(spark, d, "memories").where("status IN ('active', 'pending') AND id IS NOT NULL").groupBy("id", "category", "status").agg(F.max("updated_at").alias("u"))
    return m.orderBy(F.desc_nulls_last("u"), "id").limit(50).select("id", "category", "status")


@query("status_counts", "SELECT status, count(*) AS n, count(DISTINCT id) AS ids FROM memories GROUP BY status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("quote_check", "SELECT DISTINCT m.id, m.quote IS NOT NULL AND m.quote <> '' AND bool_or(contains(regexp_replace(lower(h.content), '\\s+', ' ', 'g'), regexp_replace(lower(trim(m.quote)), '\\s+', ' ', 'g'))) AS verbatim FROM memories m JOIN history_messages h ON h.conversation_id = m.source_conversation_id WHERE h.content IS NOT NULL GROUP BY m.id, m.quote")
def quote_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a memory's quote occurs in its conversation."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    m = table(spark, d, "memories").select("id", "quote", F.col("source_conversation_id").alias("conversation_id")).distinct()
    h = table(spark, d, "history_messages").where("content IS NOT NULL").select("conversation_id", "content")
    hit = F.col("quote").isNotNull() & (F.col("quote") != "") & F.contains(plain(F.col("content")), plain(F.trim("quote")))
    return m.join(h, "conversation_id").groupBy("id", "quote").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("verbatim")).select("id", "verbatim").distinct()


# ---- events


@query("event_sequence", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_seq FROM events")
def event_sequence(spark: SparkSession, d: str) -> DataFrame:
    """A gap-free number per user (the batch form of the event log's counter)."""
    return table(spark, d, "events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("event_seq"))


@query("event_replay", "SELECT event_id, user_id, event_seq FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_seq FROM events) WHERE event_seq > 3")
def event_replay(spark: SparkSession, d: str) -> DataFrame:
    """What a reader at offset 3 still gets of each log."""
    return event_sequence(spark, d).where("event_seq > 3")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows (an addition of this engine: the reference has none)."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("event_payload", "SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS valid FROM events GROUP BY event_type")
def event_payload(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.try_parse_json("props").isNotNull()).alias("valid"))
