"""Queries: history, memories, research, ingestion, further scalar functions, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.functions import text as T
from tessera.operators import catalog, history, ingest, markdown, memory, research, store
from tessera.operators import entries as N
from tessera.plans import search as S
from tessera.plans import state as P
from tessera.plans.catalog import query
from tessera.session import scratch_path
from tessera.streaming import event_log
from tessera.tables import table

# ---- history

ONCE = """m1 AS (SELECT message_id, arg_min(row(conversation_id, role, content, created_at, sequence), row(created_at IS NULL, created_at, content IS NOT NULL, content, sequence IS NOT NULL, sequence, role IS NOT NULL, role, conversation_id)) AS r FROM history_messages WHERE message_id IS NOT NULL GROUP BY message_id),
m AS (SELECT message_id, r[1] AS conversation_id, r[2] AS role, r[3] AS content, r[4] AS created_at, r[5] AS sequence FROM m1)"""
#: A stated set of searches (fixed values).
SEARCHES = ["glossary page", "token budget", "标题 重复", "folder scan", "search index", "会议 记录", "weekly review", "导出", "sync job", "？！"]
ASKED = "(VALUES " + ", ".join(f"({n}, {T.quoted(q)})" for n, q in enumerate(SEARCHES)) + ") v(query_id, question)"


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SEARCHES)), "query_id int, question string")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "history_messages")


@query("history_ranked", f"""WITH {ONCE}, dk AS (SELECT message_id, {T.tokens_sql('content')} AS toks FROM m WHERE content IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dk),
    po AS (SELECT message_id, len(any_value(toks)) AS dl, term, count(*) AS tf FROM (SELECT message_id, toks, unnest(toks) AS term FROM dk) GROUP BY message_id, term), q AS (SELECT query_id, list_distinct({T.tokens_sql('question')}) AS terms FROM {ASKED}),
    qx AS (SELECT query_id, len(terms) AS wanted, unnest(terms) AS term FROM q), dfq AS (SELECT term, count(*) AS df FROM po WHERE term IN (SELECT term FROM qx) GROUP BY term),
    hi AS (SELECT query_id, message_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM po JOIN qx USING (term) JOIN dfq USING (term), st GROUP BY query_id, message_id HAVING count(*) = any_value(wanted)),
    kd AS (SELECT message_id, min(conversation_id) AS c, min(lower(trim(role))) AS role, min(content) AS content, min(created_at) AS t, min(sequence) AS s FROM history_messages WHERE message_id IS NOT NULL GROUP BY message_id),
    ke AS (SELECT message_id FROM (SELECT *, CASE WHEN s = 1 AND role = 'user' AND length(content) >= 20 THEN '' ELSE message_id END AS own FROM kd) QUALIFY row_number() OVER (PARTITION BY role, content, own ORDER BY t NULLS LAST, message_id) = 1)
    SELECT query_id, message_id, conversation_id, score, sequence, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC NULLS LAST, sequence NULLS LAST, message_id) AS position FROM hi JOIN m USING (message_id) JOIN ke USING (message_id) WHERE created_at >= TIMESTAMP '2024-02-01' AND created_at < TIMESTAMP '2025-07-01'""")
def history_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Full-text search of the history: all terms, ranked, repeated openings once, in a range of days whose last is included."""
    return history.search(messages(spark, d), searches(spark), "2024-02-01", "2025-06-30").drop("created_at")


@query("history_scan", f"WITH {ONCE} SELECT message_id, matched, row_number() OVER (ORDER BY matched DESC, created_at DESC NULLS LAST, message_id) AS position FROM (SELECT *, contains(lower(content), 'glossary')::INT + contains(lower(content), 'budget')::INT + contains(lower(content), '标题')::INT AS matched FROM m WHERE content IS NOT NULL) WHERE matched > 0")
def history_scan(spark: SparkSession, d: str) -> DataFrame:
    """The scan without an index: every message, by how many terms it holds, then newest."""
    return history.scanned(messages(spark, d), ["glossary", "Budget", "标题"]).drop("created_at")


@query("history_excerpts", f"""WITH {ONCE}, t AS (SELECT message_id, content, list_filter([position('glossary' IN lower(content)), position('budget' IN lower(content))], lambda p: p > 0) AS ps FROM m WHERE content IS NOT NULL),
    a AS (SELECT *, greatest(list_min(ps) - 40, 1) AS st FROM t WHERE len(ps) > 0) SELECT message_id, CASE WHEN st > 1 THEN '…' ELSE '' END || substring(content, st, 80) || CASE WHEN st + 79 < length(content) THEN '…' ELSE '' END AS excerpt FROM a""")
def history_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """What a search shows of a message: a window around the earliest term."""
    m = history.once(messages(spark, d)).where("content IS NOT NULL").where(F.lower("content").rlike("glossary|budget"))
    return m.select("message_id", history.excerpt(F.col("content"), F.array(F.lit("glossary"), F.lit("budget"))).alias("excerpt"))


SUMMARIES = f"""{ONCE}, su AS (SELECT conversation_id, count(*) AS message_count, max(created_at) AS updated_at, max(sequence) AS last_sequence, substring(trim(regexp_replace(arg_min(content, row(sequence IS NULL, sequence, message_id)) FILTER (lower(trim(role)) IN ('user', 'human', '用户') AND content IS NOT NULL), '\\s+', ' ', 'g'), ' '), 1, 30) AS title FROM m WHERE conversation_id IS NOT NULL GROUP BY conversation_id)"""


@query("conversation_sidebar", f"WITH {SUMMARIES} SELECT conversation_id, message_count, title, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, last_sequence DESC NULLS LAST, conversation_id) AS place FROM su WHERE message_count >= 3")
def conversation_sidebar(spark: SparkSession, d: str) -> DataFrame:
    """The visible conversations (those with two messages or fewer are archived here) by last activity, with count and title."""
    s = history.summaries(messages(spark, d))
    return history.sidebar(history.visible(s, s.where("message_count < 3"))).select("conversation_id", "message_count", "title", "place")


@query("conversation_archive", f"WITH {SUMMARIES} SELECT conversation_id, row_number() OVER (ORDER BY CASE WHEN message_count % 2 = 0 THEN TIMESTAMP '2030-01-01' ELSE updated_at END DESC NULLS LAST, conversation_id) AS place FROM su WHERE message_count < 6")
def conversation_archive(spark: SparkSession, d: str) -> DataFrame:
    """The archived conversations (here the short ones, half of them with an archive time), latest first."""
    s = history.summaries(messages(spark, d))
    a = s.where("message_count < 6").select("conversation_id", F.expr("CASE WHEN message_count % 2 = 0 THEN TIMESTAMP_NTZ '2030-01-01' END").alias("archived_at"))
    return history.archive(s, a).select("conversation_id", "place")


@query("memory_titles", f"WITH {SUMMARIES} SELECT DISTINCT id, source_conversation_id, title FROM memories LEFT JOIN su ON source_conversation_id = conversation_id WHERE id IS NOT NULL")
def memory_titles(spark: SparkSession, d: str) -> DataFrame:
    """Memories with the titles of the conversations they come from."""
    rows = table(spark, d, "memories").where("id IS NOT NULL").select("id", F.col("source_conversation_id").alias("conversation_id")).distinct()
    return history.titled(rows, history.summaries(messages(spark, d))).select("id", F.col("conversation_id").alias("source_conversation_id"), "title")


@query("truncate_refs", "WITH c AS (SELECT conversation_id, 4 AS cut FROM history_messages WHERE conversation_id IS NOT NULL GROUP BY 1 HAVING max(sequence) > 5), g AS (SELECT DISTINCT message_id FROM history_messages JOIN c USING (conversation_id) WHERE sequence >= cut AND message_id IS NOT NULL) SELECT r.run, CASE WHEN g.message_id IS NULL THEN r.message_id END AS message_id FROM (SELECT DISTINCT 'run-' || message_id AS run, message_id FROM history_messages WHERE message_id IS NOT NULL) r LEFT JOIN g ON r.message_id = g.message_id")
def truncate_refs(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose message was cut away lose their reference (long conversations are cut before their fourth message)."""
    h = messages(spark, d)
    cuts = h.where("conversation_id IS NOT NULL").groupBy("conversation_id").agg(F.max("sequence").alias("s")).where("s > 5").select("conversation_id", F.lit(4).alias("cut"))
    runs = h.where("message_id IS NOT NULL").select(F.concat(F.lit("run-"), "message_id").alias("run"), "message_id").distinct()
    return history.truncate(h, cuts, runs)[1].select("run", "message_id")


@query("delete_cascade", "WITH g AS (SELECT conversation_id FROM history_messages WHERE conversation_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT message_id) > 8) SELECT DISTINCT id, CASE WHEN source_conversation_id NOT IN (SELECT conversation_id FROM g) THEN source_conversation_id END AS source_conversation_id FROM memories WHERE id IS NOT NULL")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Memories after the long conversations are deleted: their references to them are null."""
    h = messages(spark, d)
    gone = h.where("conversation_id IS NOT NULL").groupBy("conversation_id").agg(F.countDistinct("message_id").alias("n")).where("n > 8")
    m = table(spark, d, "memories").where("id IS NOT NULL").select("id", "source_conversation_id").distinct()
    return history.delete_conversations(h, gone, (m, "source_conversation_id"))[1][0].distinct()


@query("history_rebuild", "WITH i AS (SELECT DISTINCT message_id FROM history_messages WHERE sequence IS NOT NULL AND message_id IS NOT NULL), m AS (SELECT DISTINCT message_id FROM history_messages WHERE content IS NOT NULL AND message_id IS NOT NULL) SELECT (SELECT count(*) FROM m ANTI JOIN i USING (message_id)) AS missing, (SELECT count(*) FROM i ANTI JOIN m USING (message_id)) AS orphaned, true AS rebuild")
def history_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index must be built anew: it was made with other terms here."""
    h = messages(spark, d).where("message_id IS NOT NULL")
    return history.missing_index(h, h.where("sequence IS NOT NULL"), "terms-2", "terms-1")


# ---- memories


@query("memory_index_sync", """WITH l AS (SELECT id, arg_max(row(coalesce(status, ''), coalesce(content_hash, '')), row(updated_at IS NOT NULL, updated_at, coalesce(status, ''), coalesce(content_hash, ''))) AS r FROM memories WHERE id IS NOT NULL GROUP BY id), a AS (SELECT id, r[2] AS h FROM l WHERE r[1] = 'active'),
    i AS (SELECT id, CASE WHEN length(min(statement)) % 5 = 0 THEN 'old' ELSE min(coalesce(content_hash, '')) END AS i FROM memories WHERE id IS NOT NULL AND statement IS NOT NULL GROUP BY id HAVING length(min(statement)) % 3 > 0)
    SELECT coalesce(i.id, a.id) AS id, CASE WHEN h IS NULL THEN 'remove' WHEN i IS NULL THEN 'add' WHEN h <> i THEN 'update' ELSE 'keep' END AS action FROM i FULL JOIN a ON i.id = a.id""")
def memory_index_sync(spark: SparkSession, d: str) -> DataFrame:
    """What brings a stale vector index of memories up to their authoritative state (the index lacks a third, a fifth is old)."""
    m = table(spark, d, "memories")
    i = m.where("id IS NOT NULL AND statement IS NOT NULL").groupBy("id").agg(F.length(F.min("statement")).alias("n"), F.min(F.coalesce("content_hash", F.lit(""))).alias("h")).where("n % 3 > 0").select("id", F.expr("CASE WHEN n % 5 = 0 THEN 'old' ELSE h END").alias("content_hash"))
    return memory.index_changes(i, m)


@query("memory_matches")
def memory_matches(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest active memories of every question (a vector search; the index may be stale)."""
    from tessera.operators import dense, hybrid

    m = table(spark, d, "memories").where("id IS NOT NULL AND statement IS NOT NULL")
    rows = m.groupBy("id").agg(F.min("statement").alias("s")).select("id", hybrid.hashed_embedding(F.col("s")).alias("v"))
    hits = dense.top_k(spark, rows, "id", "v", S.questions(spark, d).select("query_id", hybrid.hashed_embedding(F.col("question")).alias("v")), "query_id", "v", memory.CANDIDATES)
    return memory.matches(hits, table(spark, d, "memories"))


@query("memory_orphans", "SELECT DISTINCT id, CASE WHEN coalesce(source_conversation_id, '') <> '' AND source_conversation_id NOT IN (SELECT conversation_id FROM history_messages WHERE conversation_id IS NOT NULL) AND status IS DISTINCT FROM 'forgotten' THEN 'orphaned' ELSE status END AS status FROM memories WHERE id IS NOT NULL")
def memory_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Memories whose conversation is gone are orphaned, but for forgotten ones."""
    return memory.orphaned(table(spark, d, "memories").where("id IS NOT NULL"), messages(spark, d).where("conversation_id IS NOT NULL")).select("id", "status").distinct()


@query("memory_signals", "SELECT conversation_id, count(DISTINCT message_id) AS turns FROM history_messages WHERE message_id IS NOT NULL AND conversation_id IS NOT NULL AND lower(trim(role)) IN ('user', 'human', '用户') AND length(trim(content)) >= 6 AND (" + " OR ".join(f"contains(lower(content), {T.quoted(x)})" for x in memory.MARKERS) + ") GROUP BY conversation_id")
def memory_signals(spark: SparkSession, d: str) -> DataFrame:
    """The conversations with turns that may hold a memory."""
    return memory.signalled(messages(spark, d))


@query("memory_upsert", """WITH b AS (SELECT *, sha256(category || chr(0) || trim(regexp_replace(lower(statement), '\\s+', ' ', 'g'))) AS h FROM memories WHERE coalesce(trim(category), '') <> '' AND coalesce(trim(statement), '') <> ''),
    o AS (SELECT h, arg_min(category, id) AS category, max(CASE WHEN confidence IS NOT NULL AND NOT isnan(confidence) THEN least(greatest(confidence, 0), 1) END) AS confidence, CASE WHEN bool_or(status = 'forgotten') THEN 'forgotten' WHEN bool_or(status = 'superseded') THEN 'superseded' ELSE 'pending' END AS status FROM b WHERE length(statement) % 2 = 0 GROUP BY h),
    c AS (SELECT h, min(category) AS category, max(least(greatest(confidence, 0), 1)) AS c2 FROM b WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY h),
    j AS (SELECT coalesce(o.h, c.h) AS h, o.h IS NULL AS new, status, CASE WHEN o.confidence IS NULL THEN c2 WHEN c2 IS NULL THEN o.confidence ELSE greatest(o.confidence, c2) END AS best FROM o FULL JOIN c ON o.h = c.h)
    SELECT h AS content_hash, round(best, 6) AS confidence, CASE WHEN new THEN CASE WHEN best < 0.5 THEN 'pending' ELSE 'active' END WHEN status = 'pending' AND best >= 0.5 THEN 'active' ELSE status END AS status FROM j""")
def memory_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Stored memories (those of even length, pending unless put away) after all rows arrive again: weak ones wait, known ones
    wake, forgotten ones stay."""
    m = table(spark, d, "memories").where("coalesce(trim(category), '') <> '' AND coalesce(trim(statement), '') <> ''")
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    stored = m.where("length(statement) % 2 = 0").groupBy(memory.identity(F.col("category"), F.col("statement")).alias("content_hash")).agg(
        F.min_by("category", "id").alias("category"), F.min_by("statement", "id").alias("statement"), F.max(memory.confidence(F.col("confidence"))).alias("confidence"), F.when(has("forgotten"), "forgotten").when(has("superseded"), "superseded").otherwise("pending").alias("status"), F.lit(0).alias("pinned"), F.max("updated_at").alias("updated_at")
    )
    out = memory.upsert(stored, m.select("category", "statement", "confidence", F.col("updated_at").alias("at")))
    return out.select("content_hash", F.round("confidence", 6).alias("confidence"), "status")


@query("memory_operations", """WITH b AS (SELECT id, min(statement) AS s FROM memories WHERE id IS NOT NULL AND statement IS NOT NULL GROUP BY id), n AS (SELECT *, length(s) AS n FROM b)
    SELECT id AS key, CASE WHEN n % 4 = 1 THEN 'new' ELSE s END AS statement, CASE n % 4 WHEN 0 THEN 'forgotten' WHEN 2 THEN 'superseded' ELSE 'active' END AS status, n % 4 <> 3 AS enabled, CASE WHEN n % 8 = 7 THEN 1 ELSE 2 END AS revision FROM n WHERE n % 8 <> 7 UNION ALL SELECT id, s, 'active', true, 1 FROM n WHERE n % 8 = 7""")
def memory_operations(spark: SparkSession, d: str) -> DataFrame:
    """Memories after a batch of operations, each delivered twice: forgotten, updated, superseded or disabled by their length; every
    eighth operation expects a revision that is not there and does nothing."""
    b = table(spark, d, "memories").where("id IS NOT NULL AND statement IS NOT NULL").groupBy("id").agg(F.min("statement").alias("statement"))
    current = b.select(F.col("id").alias("key"), "statement", F.lit("active").alias("status"), F.lit(True).alias("enabled"), F.lit(1).cast("long").alias("revision"))
    n = F.length("statement")
    kind = F.when(n % 4 == 0, "forget").when(n % 4 == 1, "update").when(n % 4 == 2, "supersede").otherwise("disable")
    ops = b.select(F.concat(F.lit("op-"), "id").alias("operation_id"), F.lit(1).alias("seq"), kind.alias("kind"), F.col("id").alias("key"), F.lit("new").alias("statement"), F.when(n % 8 == 7, 9).cast("long").alias("expected"))
    none = ops.select("operation_id").limit(0)
    state, done = memory.mutate(current, ops.unionByName(ops), none)
    return memory.mutate(state, ops, done)[0].withColumn("revision", F.col("revision").cast("int"))


@query("memory_snapshot", """WITH o AS (SELECT category, id, max(row(coalesce(user_pinned, 0), updated_at IS NOT NULL, updated_at, statement)) AS r FROM memories WHERE status = 'active' AND id IS NOT NULL AND statement IS NOT NULL GROUP BY ALL), s AS (SELECT category, id, r[1] AS p, r[3] AS u, r[4] AS statement FROM o),
    w AS (SELECT *, sum(length(statement) + 1) OVER (PARTITION BY category ORDER BY p DESC, u DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS t, row_number() OVER (PARTITION BY category ORDER BY p DESC, u DESC NULLS LAST, id) AS n FROM s)
    SELECT category, coalesce(string_agg(statement, chr(10) ORDER BY n) FILTER (t <= 2000), '') AS text, count(*) FILTER (t > 2000) AS more FROM w GROUP BY category""")
def memory_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The text of each category's memories that fits 2,000 characters."""
    return memory.snapshot(table(spark, d, "memories"))


@query("memory_candidates", """SELECT message_id AS answer_id, 1 AS n, category, statement, round(c / 2, 6) AS confidence FROM (SELECT id AS message_id, min(category) AS category, min(statement) AS statement, max(least(greatest(confidence, 0), 1)) AS c FROM memories WHERE id IS NOT NULL GROUP BY id) WHERE category IN ('preference', 'fact', 'goal', 'project', 'instruction') AND coalesce(trim(statement), '') <> '' AND c IS NOT NULL""")
def memory_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Memories read back from the JSON a model would write around them (prose, a fence, an unconfirmed candidate)."""
    m = table(spark, d, "memories").where("id IS NOT NULL").groupBy("id").agg(F.min("category").alias("category"), F.min("statement").alias("statement"), F.max(memory.confidence(F.col("confidence"))).alias("confidence"))
    text = F.concat(F.lit("Here they are:\n```json\n"), F.to_json(F.struct(F.array(F.struct("category", "statement", F.col("confidence").cast("string").alias("confidence"))).alias("memories"))), F.lit("\n```\nDone."))
    return memory.parsed(m.select(F.col("id").alias("answer_id"), text.alias("answer"))).select("answer_id", "n", "category", "statement", F.round("confidence", 6).alias("confidence"))


@query("revocations", "WITH u AS (SELECT conversation_id, message_id, min(content) AS c FROM history_messages WHERE message_id IS NOT NULL AND lower(trim(role)) IN ('user', 'human', '用户') GROUP BY ALL), k AS (SELECT *, CASE WHEN " + " OR ".join(f"contains(lower(c), {T.quoted(w)})" for w in memory.INSTRUCTIONS["drop"]) + " THEN 'drop' WHEN " + " OR ".join(f"contains(lower(c), {T.quoted(w)})" for w in memory.INSTRUCTIONS["change"]) + " THEN 'change' END AS kind FROM u) SELECT conversation_id, message_id, kind FROM k WHERE kind IS NOT NULL")
def revocations(spark: SparkSession, d: str) -> DataFrame:
    """The user's turns that take an instruction back, by kind."""
    return memory.revocations(messages(spark, d))


@query("revoked_requirements", "WITH i AS (SELECT message_id, sequence, note, conversation_id FROM history_messages WHERE invalidated AND message_id IS NOT NULL), f AS (SELECT conversation_id, arg_min(row(message_id, note), row(sequence IS NULL, sequence, message_id, note IS NOT NULL, note)) AS r FROM i GROUP BY conversation_id) SELECT c.conversation_id AS requirement_id, r[1] AS message_id, r[2] AS note FROM (SELECT DISTINCT conversation_id FROM history_messages WHERE conversation_id IS NOT NULL) c LEFT JOIN f ON c.conversation_id = f.conversation_id")
def revoked_requirements(spark: SparkSession, d: str) -> DataFrame:
    """For every requirement (here one a conversation) the first invalidated message that revokes it, with its note."""
    h = messages(spark, d)
    r = h.where("conversation_id IS NOT NULL").select(F.col("conversation_id").alias("requirement_id")).distinct()
    m = h.where("invalidated AND message_id IS NOT NULL AND conversation_id IS NOT NULL").select("message_id", "sequence", "note", F.array("conversation_id").alias("revokes"))
    return memory.revoked(r, m)


# ---- research

SNIPPETS = """ev AS (SELECT id || '-' || ord AS evidence_id, CASE WHEN ord = 1 THEN 'knowledge' ELSE 'web' END AS source_type, e.doc AS source_ref, e.snippet AS content, e.doc AS title, '' AS heading, id FROM (SELECT id, unnest(evidence) AS e, generate_subscripts(evidence, 1) AS ord FROM eval_questions))"""


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """Every evidence snippet as a piece of evidence (of knowledge the first, of the web the others)."""
    q = table(spark, d, "eval_questions").select("id", F.posexplode("evidence").alias("n", "e"))
    n = F.col("n") + 1
    return q.select(F.concat("id", F.lit("-"), n.cast("string")).alias("evidence_id"), F.when(n == 1, "knowledge").otherwise("web").alias("source_type"), F.col("e.doc").alias("source_ref"), F.col("e.snippet").alias("content"), F.col("e.doc").alias("title"), F.lit("").alias("heading"), "id")


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_questions").select(F.posexplode("answer_points").alias("n", "text"), "id").select(F.concat("id", F.lit("/"), F.col("n").cast("string")).alias("requirement_id"), "text", F.col("id").alias("run"))


def support_sql(question: str, text: str) -> str:
    """The rule of support without a focus, for requirements that are statements."""
    tok = f"list_filter(list_distinct({T.tokens_sql(question)}), lambda t: NOT ({T.low_information_sql('t')}))"
    hit = f"len(list_filter({tok}, lambda t: contains(lower({text}), t)))"
    return f"({hit} > 0 AND ({hit} >= 3 OR {hit} >= 0.2 * len({tok})))"


FOCUS = X.FOCUS
POINTS = "pt AS (SELECT id || '/' || (n - 1) AS requirement_id, text, id AS run FROM (SELECT id, unnest(answer_points) AS text, generate_subscripts(answer_points, 1) AS n FROM eval_questions))"
STOPS = "[" + "".join(w for w in X.FOCUS_STOP if len(w) == 1) + "]"
FOCUS_SQL = f"regexp_replace(regexp_replace(regexp_extract(regexp_replace(text, '\\s+', '', 'g'), '{FOCUS}', 1), '^[的了把将]+', ''), '{STOPS}', '', 'g')"
FTOK = f"CASE WHEN length(fo) >= 2 THEN list_filter(list_distinct({T.tokens_sql('fo')}), lambda t: NOT ({T.low_information_sql('t')}) AND t NOT IN ({', '.join(T.quoted(w) for w in X.FOCUS_STOP)})) ELSE [] END"
ATTRIBUTED = f"""{SNIPPETS}, {POINTS}, p1 AS (SELECT *, {FOCUS_SQL} AS fo, list_filter(list_distinct({T.tokens_sql('text')}), lambda t: NOT ({T.low_information_sql('t')})) AS tk FROM pt), p2 AS (SELECT *, {FTOK} AS ft FROM p1),
a0 AS (SELECT evidence_id, requirement_id, len(list_filter(tk, lambda t: contains(lower(content), t))) AS hits, len(tk) AS n, len(ft) = 0 OR len(list_filter(ft, lambda t: contains(lower(content), t))) > 0 AS focused FROM ev, p2),
att AS (SELECT evidence_id, requirement_id FROM a0 WHERE hits > 0 AND (hits >= 3 OR hits >= 0.2 * n) AND focused)"""


@query("attribution", f"WITH {ATTRIBUTED} SELECT evidence_id, requirement_id FROM att")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    """Which evidence supports which answer point, over all items."""
    return research.attributed(snippets(spark, d), points(spark, d).select("requirement_id", "text"))


@query("requirement_coverage", f"WITH {ATTRIBUTED}, g AS (SELECT requirement_id, count(DISTINCT evidence_id) AS n FROM att GROUP BY requirement_id), c AS (SELECT pt.requirement_id, run, CASE WHEN n > 0 THEN 'answered' ELSE 'missing' END AS state FROM pt LEFT JOIN g USING (requirement_id)) SELECT run, bool_and(state = 'answered') AS complete, count(*) FILTER (state <> 'answered') AS open, bool_and(state <> 'missing') AS supported FROM c GROUP BY run")
def requirement_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether every answer point of an item is supported by evidence."""
    p, e = points(spark, d), snippets(spark, d)
    covered = research.coverage(p, research.attributed(e, p.select("requirement_id", "text")), e)
    return research.complete(covered.join(p.select("requirement_id", "run"), "requirement_id"), "run")


@query("evidence_dedup", f"WITH {SNIPPETS}, f AS (SELECT source_type, source_ref, content, min(evidence_id) AS evidence_id FROM ev GROUP BY ALL) SELECT evidence_id FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.source_type = f.source_type AND o.source_ref = f.source_ref AND length(o.content) > length(f.content) AND contains(o.content, f.content) AND length(f.content) > 0)")
def evidence_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Evidence without copies and without texts that stand in a longer one of the same document."""
    return research.deduplicated(snippets(spark, d).drop("id")).select("evidence_id")


@query("gap_disclosure")
def gap_disclosure(spark: SparkSession, d: str) -> DataFrame:
    """Whether the evidence of an item says openly that one of its answer points is missing (rules of language: tested on cases)."""
    paragraphs = snippets(spark, d).select(F.col("id").alias("answer_id"), F.explode(F.split("content", r"\n\s*\n")).alias("paragraph")).distinct()
    return research.disclosed(paragraphs, points(spark, d).select(F.col("run").alias("answer_id"), "requirement_id", "text"))


@query("quoted_terms", r"""WITH a AS (SELECT DISTINCT message_id, content FROM conversation_messages WHERE message_id IS NOT NULL AND content IS NOT NULL), q AS (SELECT DISTINCT message_id, unnest(regexp_extract_all(content, '「[^「」\n]{2,120}」|『[^『』\n]{2,120}』|“[^“”\n]{2,120}”|"[^"\n]{2,120}"')) AS q FROM a), t AS (SELECT DISTINCT message_id, substring(q, 2, length(q) - 2) AS term FROM q),
    l AS (SELECT DISTINCT message_id, sources AS line FROM conversation_messages WHERE message_id IS NOT NULL AND sources IS NOT NULL) SELECT message_id AS answer_id, term FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.message_id = t.message_id AND contains(line, term))""")
def quoted_terms(spark: SparkSession, d: str) -> DataFrame:
    """Quoted terms of messages that their sources do not hold."""
    c = table(spark, d, "conversation_messages").where("message_id IS NOT NULL")
    return research.quoted_terms(c.where("content IS NOT NULL").select(F.col("message_id").alias("answer_id"), F.col("content").alias("answer")).distinct(), c.where("sources IS NOT NULL").select(F.col("message_id").alias("answer_id"), F.col("sources").alias("line")), c.select(F.col("message_id").alias("answer_id"), F.lit("").alias("heading")).limit(0))


@query("unsupported_claims")
def unsupported_claims(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with units in the answer points that no evidence of the item states (with a tolerance; tested on cases)."""
    q = table(spark, d, "eval_questions")
    return research.unsupported_claims(q.select(F.col("id").alias("answer_id"), F.array_join("answer_points", "\n").alias("answer")), q.select(F.col("id").alias("answer_id"), F.explode("evidence.snippet").alias("line")))


URLS = """ms AS (SELECT DISTINCT conversation_id, message_id, coalesce(created_at, '') AS t, sources FROM conversation_messages WHERE conversation_id IS NOT NULL AND message_id IS NOT NULL AND json_valid(sources)),
u0 AS (SELECT conversation_id, message_id, t, unnest(from_json(sources, '[{"source_file": "VARCHAR"}]')).source_file AS f, generate_subscripts(from_json(sources, '[{"source_file": "VARCHAR"}]'), 1) AS n FROM ms),
ur AS (SELECT conversation_id, f, row_number() OVER (PARTITION BY conversation_id ORDER BY t, message_id, n, f) AS ord FROM u0 WHERE regexp_full_match(f, '[A-Za-z0-9_/.-]+'))"""


def addresses(spark: SparkSession, d: str) -> DataFrame:
    """The sources that messages name, as addresses of a site for each folder, in order of their use."""
    m = table(spark, d, "conversation_messages").where(F.col("conversation_id").isNotNull() & F.col("message_id").isNotNull() & F.try_parse_json("sources").isNotNull()).select("conversation_id", "message_id", F.coalesce("created_at", F.lit("")).alias("t"), "sources").distinct()
    s = m.select("conversation_id", "message_id", "t", F.posexplode(F.from_json("sources", "array<struct<source_file:string>>")).alias("n", "s")).select("*", F.col("s.source_file").alias("f")).where(F.col("f").rlike("^[A-Za-z0-9_/.-]+$"))
    order = Window.partitionBy("conversation_id").orderBy("t", "message_id", "n", "f")
    url = F.concat(F.lit("HTTPS://"), F.upper(F.regexp_replace(F.substring_index("f", "/", 1), "_", "-")), F.lit(".Example//"), "f", F.lit("?utm_source=chat#top"))
    return s.select(F.col("conversation_id").alias("query_id"), url.alias("url"), "f", F.row_number().over(order).alias("ord"))


@query("url_families", f"WITH {URLS}, f AS (SELECT conversation_id, f, min(ord) AS first FROM ur GROUP BY ALL) SELECT conversation_id AS query_id, 'https://' || lower(replace(string_split(f, '/')[1], '_', '-')) || '.example/' || f AS family, place FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY first) AS place FROM f) WHERE place <= 3")
def url_families(spark: SparkSession, d: str) -> DataFrame:
    """The first three different addresses of every conversation (the limit is the feature)."""
    return research.url_families(addresses(spark, d), 3).select("query_id", "family", "place")


@query("source_hosts", f"WITH {URLS} SELECT conversation_id AS query_id, count(DISTINCT lower(replace(string_split(f, '/')[1], '_', '-')) || '.example') AS hosts, count(DISTINCT f) AS sources FROM ur GROUP BY 1")
def source_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Independent sources of every conversation: the hosts behind its addresses."""
    a = addresses(spark, d).withColumn("url", T.web_url(F.col("url")))
    return a.groupBy("query_id").agg(F.countDistinct(F.try_parse_url("url", F.lit("HOST"))).alias("hosts"), F.countDistinct("url").alias("sources"))


@query("web_ranking", f"WITH {SNIPPETS}, h AS (SELECT q.id AS query_id, ev.evidence_id AS url, content AS snippet, row_number() OVER (PARTITION BY q.id ORDER BY ev.evidence_id) AS ord, list_filter(list_distinct({T.tokens_sql('question')}), lambda t: NOT ({T.low_information_sql('t')})) AS tk FROM eval_questions q JOIN ev ON length(q.id) = length(ev.id) AND substring(q.id, length(q.id), 1) = substring(ev.id, length(ev.id), 1)), s AS (SELECT *, len(list_filter(tk, lambda t: contains(lower(snippet), t))) AS o FROM h) SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, ord, url) AS place FROM s")
def web_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The order in which hits are read: by shared tokens, then arrival (hits: the evidence of items whose id ends alike)."""
    q, e = table(spark, d, "eval_questions").select("id", "question"), snippets(spark, d).withColumnRenamed("id", "eid")
    h = q.join(e, (F.length("id") == F.length("eid")) & (F.substring("id", -1, 1) == F.substring("eid", -1, 1))).select(F.col("id").alias("query_id"), "question", F.col("evidence_id").alias("url"), F.lit("").alias("title"), F.col("content").alias("snippet"), F.lit(None).cast("double").alias("score"), F.row_number().over(Window.partitionBy("id").orderBy("evidence_id")).alias("ord"))
    return research.ranked_hits(h).select("query_id", "url", "place")


@query("read_targets", f"""WITH hd AS (SELECT DISTINCT doc_id, heading_path AS heading FROM blocks WHERE source_type = 'document' AND doc_id IS NOT NULL AND coalesce(heading_path, '') <> ''), ht AS (SELECT *, list_distinct({T.tokens_sql('heading')}) AS ht FROM hd),
    q AS (SELECT id AS query_id, list_filter(list_distinct({T.tokens_sql('question')}), lambda t: NOT ({T.low_information_sql('t')})) AS tk FROM eval_questions), j AS (SELECT query_id, doc_id, heading, len(list_intersect(tk, ht)) * 10 AS points FROM q, ht WHERE len(list_intersect(tk, ht)) > 0)
    SELECT query_id, doc_id, heading, points::DOUBLE AS points, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id, heading) AS place FROM j) WHERE place <= 2""")
def read_targets(spark: SparkSession, d: str) -> DataFrame:
    """The two headings to read next for every question (they meet through a shared token)."""
    h = N.entries(table(spark, d, "blocks")).where("kind = 'heading'").select("doc_id", F.col("heading_path").alias("heading")).distinct()
    q = S.questions(spark, d)
    pairs = q.select("query_id", F.explode(X.support_tokens(F.col("question"))).alias("t")).join(h.select("doc_id", "heading", F.explode(F.array_distinct(T.tokens(F.col("heading")))).alias("t")), "t").select("query_id", "doc_id", "heading").distinct()
    return research.read_targets(pairs.join(q, "query_id").withColumn("similarity", F.lit(None).cast("double")))


@query("reused_reads", """WITH b AS (SELECT block_id, any_value(doc_id) AS doc_id, min(document_order) AS o FROM blocks WHERE block_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY block_id HAVING min(document_order) IS NOT NULL), r AS (SELECT block_id AS read_id, doc_id, o * 100 AS a, o * 100 + 250 AS b FROM b WHERE o % 2 = 1), w AS (SELECT block_id AS window_id, doc_id, o * 100 AS a, o * 100 + 400 + 10 * o AS b FROM b WHERE o % 2 = 0)
    SELECT read_id, arg_min(window_id, row(w.b - w.a, window_id)) AS window_id FROM r LEFT JOIN w ON r.doc_id = w.doc_id AND w.a <= r.a AND r.b <= w.b GROUP BY read_id""")
def reused_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads that a stored window of the document covers whole, with the smallest such window (spans made of the blocks' orders)."""
    b = table(spark, d, "blocks").where("block_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("block_id").agg(F.first("doc_id").alias("doc_id"), F.min("document_order").alias("o")).where("o IS NOT NULL")
    r = b.where("o % 2 = 1").select(F.col("block_id").alias("read_id"), "doc_id", (F.col("o") * 100).alias("start"), (F.col("o") * 100 + 250).alias("stop"))
    w = b.where("o % 2 = 0").select(F.col("block_id").alias("window_id"), "doc_id", (F.col("o") * 100).alias("start"), (F.col("o") * 110 + 400).alias("stop"))
    return research.reused(r, w).select("read_id", "window_id")


@query("merged_queries")
def merged_queries(spark: SparkSession, d: str) -> DataFrame:
    """The questions, each followed by itself in another form, merged to one each (tested on cases)."""
    q = table(spark, d, "eval_questions").select(F.col("id").alias("query_id"), "question")
    return research.merged_queries(q.withColumn("ord", F.lit(1)).unionByName(q.select(F.concat("query_id", F.lit("b")).alias("query_id"), F.concat(F.lit("  "), "question", F.lit("？")).alias("question"), F.lit(2).alias("ord"))))


@query("page_windows", "SELECT doc_id AS page_id, md5(substring(text, 501, 800)) AS h, length(text) AS characters, length(text) <= 1300 AS complete, CASE WHEN length(text) > 1300 THEN 1300 END AS next FROM documents WHERE text IS NOT NULL")
def page_windows(spark: SparkSession, d: str) -> DataFrame:
    """Characters 500 to 1,300 of every document as a page, with where the next window begins."""
    w = research.page_window(table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("page_id"), "text"), 500, 800)
    return w.select("page_id", F.md5(F.col("part").cast("binary")).alias("h"), "characters", "complete", "next")


@query("page_headings")
def page_headings(spark: SparkSession, d: str) -> DataFrame:
    """The headings that enclose the start of each window (tested on cases)."""
    return research.page_window(table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("page_id"), "text"), 500, 800).select("page_id", "heading_path")


# ---- ingestion


@query("upload_diff", f"WITH {P.DIFF} SELECT path, action FROM diff WHERE action <> 'deleted' OR starts_with(path, 'journal/')")
def upload_diff(spark: SparkSession, d: str) -> DataFrame:
    """The diff of an upload into one folder: nothing outside it is deleted."""
    return ingest.uploaded(*P.snapshots(spark, d), "journal")


@query("manifest_after_sync", f"WITH {P.DIFF} SELECT n.path, n.content_hash, n.mtime, n.size FROM now n JOIN diff USING (path) WHERE action IN ('added', 'updated', 'touched', 'unchanged')")
def manifest_after_sync(spark: SparkSession, d: str) -> DataFrame:
    """The manifest that a sync leaves."""
    return ingest.applied(*P.snapshots(spark, d))[0]


@query("ingest_outcome")
def ingest_outcome(spark: SparkSession, d: str) -> DataFrame:
    """One row about a full ingestion: documents, chunks, failures (a parser: no SQL)."""
    return ingest.outcome(markdown.chunk_documents(table(spark, d, "documents")))


@query("block_rows")
def block_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows an index stores of all chunks (a parser: no SQL; ids and hashes tested)."""
    docs = table(spark, d, "documents")
    return ingest.block_rows(markdown.chunk_documents(docs), docs).select("block_id", "doc_id", "chunk_type", "document_order", "dedup_key", "heading_aliases")


@query("subject_split")
def subject_split(spark: SparkSession, d: str) -> DataFrame:
    """Text chunks without a heading, split where the subject changes (tested on cases)."""
    return ingest.split_by_subject(markdown.chunk_documents(table(spark, d, "documents"))).select("doc_id", "block_id", F.length("chunk").alias("n"))


@query("picture_blocks", """WITH b AS (SELECT block_id, min(chunk_type) AS ct, min(image_content_hash) AS h FROM blocks WHERE block_id IS NOT NULL GROUP BY block_id), f AS (SELECT content_hash, arg_min(description, row(created_at IS NULL, created_at, description)) AS d FROM image_descriptions GROUP BY content_hash)
    SELECT block_id, CASE WHEN d IS NOT NULL THEN 'content' ELSE 'pending' END AS state FROM b LEFT JOIN f ON b.h = f.content_hash WHERE ct = 'image_description'""")
def picture_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Where the description of every picture block comes from (no cache by path here)."""
    i = table(spark, d, "image_descriptions")
    return ingest.picture_blocks(table(spark, d, "blocks"), i.select(F.lit("").alias("image_path"), "description").limit(0), i).select("block_id", "state")


@query("picture_texts")
def picture_texts(spark: SparkSession, d: str) -> DataFrame:
    """What of each picture is indexed, and the text around it (rules of text: tested on cases)."""
    i = table(spark, d, "image_descriptions")
    return ingest.picture_blocks(table(spark, d, "blocks"), i.select(F.lit("").alias("image_path"), "description").limit(0), i).select("block_id", "indexed", "context")


@query("vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 2.0 * embedding[1] ELSE embedding[1] END::DOUBLE AS first FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 3 = 0")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A vector table after an upsert with checked dimension: every third vector is new, every seventh was not there."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    new = e.where("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    dim = e.select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    return ingest.upsert(e.where("vec_id % 7 <> 0"), new, dim["n"] if dim else 0, "vec_id").select("vec_id", F.element_at("embedding", 1).cast("double").alias("first"))


@query("vector_delete", "SELECT block_id FROM blocks WHERE NOT coalesce(source_type = 'conversation' OR document_order > 5, false) AND block_id NOT IN (SELECT block_id FROM blocks WHERE chunk_type = 'code' AND block_id IS NOT NULL)")
def vector_delete(spark: SparkSession, d: str) -> DataFrame:
    """Blocks after deleting by a predicate, then by keys."""
    b = table(spark, d, "blocks").where("block_id IS NOT NULL")
    left = ingest.delete_where(b, (F.col("source_type") == "conversation") | (F.col("document_order") > 5))
    return store.delete(left, b.where("chunk_type = 'code'").select("block_id").distinct(), "block_id").select("block_id")


@query("source_blocks", "SELECT block_id, md5(text) AS h FROM blocks WHERE source_file = 'exports/assistant-log.md'")
def source_blocks(spark: SparkSession, d: str) -> DataFrame:
    """All blocks of one file."""
    return ingest.blocks_of_source(table(spark, d, "blocks"), "exports/assistant-log.md").select("block_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("block_listing", "SELECT block_id, source_type, chunk_type, source_file FROM blocks")
def block_listing(spark: SparkSession, d: str) -> DataFrame:
    """A whole scan without vectors and texts."""
    return ingest.listed(table(spark, d, "blocks"), "text").select("block_id", "source_type", "chunk_type", "source_file")


MIGRATION = """o AS (SELECT DISTINCT block_id, doc_id, coalesce(heading_path, '') AS hp, sha256(text) AS h FROM (SELECT block_id, any_value(doc_id) AS doc_id, any_value(heading_path) AS heading_path, any_value(text) AS text FROM blocks WHERE block_id IS NOT NULL AND text IS NOT NULL GROUP BY block_id)),
n AS (SELECT block_id || '~' AS block_id, doc_id, CASE WHEN length(hp) % 4 = 1 THEN hp || ' > x' ELSE hp END AS hp, CASE WHEN length(block_id) % 2 = 0 AND length(hp) % 5 = 2 THEN sha256(h) ELSE h END AS h FROM o),
o1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hp, h ORDER BY block_id) AS k FROM o), n1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hp, h ORDER BY block_id) AS k FROM n),
sm AS (SELECT n1.block_id, o1.block_id AS source FROM n1 JOIN o1 USING (doc_id, hp, h, k)),
o2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY block_id) AS k FROM o WHERE block_id NOT IN (SELECT source FROM sm)), n2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY block_id) AS k FROM n WHERE block_id NOT IN (SELECT block_id FROM sm)),
mv AS (SELECT n2.block_id, o2.block_id AS source FROM n2 JOIN o2 USING (doc_id, h, k)), tk AS (SELECT * FROM sm UNION ALL SELECT * FROM mv)"""


@query("migration", f"WITH {MIGRATION} SELECT block_id, 'kept' AS action, source FROM sm UNION ALL SELECT block_id, 'moved', source FROM mv UNION ALL SELECT block_id, 'new', NULL FROM n WHERE block_id NOT IN (SELECT block_id FROM tk) UNION ALL SELECT block_id, 'gone', NULL FROM o WHERE block_id NOT IN (SELECT source FROM tk)")
def migration(spark: SparkSession, d: str) -> DataFrame:
    """A change of representation: which blocks keep their vectors (some headings and some texts differ)."""
    once = table(spark, d, "blocks").where("block_id IS NOT NULL AND text IS NOT NULL").groupBy("block_id").agg(F.first("doc_id").alias("doc_id"), F.first("heading_path").alias("heading_path"), F.first("text").alias("text"))
    hp, own = F.coalesce("heading_path", F.lit("")), F.col("text")
    changed = (F.length("block_id") % 2 == 0) & (F.length(hp) % 5 == 2)
    new = once.select(F.concat("block_id", F.lit("~")).alias("block_id"), "doc_id", F.when(F.length(hp) % 4 == 1, F.concat(hp, F.lit(" > x"))).otherwise(hp).alias("heading_path"), F.when(changed, F.sha2(own.cast("binary"), 256)).otherwise(own).alias("text"))
    return ingest.migrated(once, new).select("block_id", "action", "source")


@query("sync_progress", "WITH s AS (SELECT user_id AS task_id, event_type AS path, arg_max(CASE WHEN value > 50 THEN 'done' WHEN value > 20 THEN 'failed' ELSE 'running' END, row(ts, CASE WHEN value > 50 THEN 'done' WHEN value > 20 THEN 'failed' ELSE 'running' END)) AS state FROM events GROUP BY ALL) SELECT task_id, count(*) AS files, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, bool_and(state IN ('done', 'failed')) AS ended FROM s GROUP BY task_id")
def sync_progress(spark: SparkSession, d: str) -> DataFrame:
    """The progress of tasks from their latest states (events as states)."""
    state = F.when(F.col("value") > 50, "done").when(F.col("value") > 20, "failed").otherwise("running")
    return ingest.progress(table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("path"), state.alias("state"), F.col("ts").alias("at")))


@query("payload_check")
def payload_check(spark: SparkSession, d: str) -> DataFrame:
    """Events by type, and how many payloads have what their type needs (tested on cases)."""
    e = ingest.valid_payloads(table(spark, d, "events"), {"click": ["k"], "purchase": ["k"]})
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"))


# ---- scalar functions


@query("day_ranges", "SELECT message_id, bool_or(strftime(created_at, '%Y-%m-%d') BETWEEN '2024-03-01' AND '2024-12-31') AS by_text, bool_or(created_at >= TIMESTAMP '2024-03-01' AND created_at < TIMESTAMP '2025-01-01') AS by_time, max(strftime(created_at, '%Y-%m-%dT%H:%M:%SZ')) AS iso FROM history_messages WHERE created_at IS NOT NULL AND message_id IS NOT NULL GROUP BY message_id")
def day_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Messages in a range of days, by their text and by their time, and their time as text."""
    h = messages(spark, d).where("created_at IS NOT NULL AND message_id IS NOT NULL").withColumn("t", F.col("created_at").cast("timestamp"))
    return h.groupBy("message_id").agg(F.bool_or(X.day_in_range(F.date_format("t", "yyyy-MM-dd HH:mm"), "2024-03-01", "2024-12-31")).alias("by_text"), F.bool_or(X.within_days(F.col("t"), "2024-03-01", "2024-12-31")).alias("by_time"), F.max(X.iso_seconds(F.col("t"))).alias("iso"))


@query("relative_days", "WITH n AS (SELECT DISTINCT created_at + INTERVAL 8 HOUR AS l FROM history_messages WHERE created_at IS NOT NULL), x AS (SELECT DISTINCT l::DATE AS t FROM n) SELECT t::VARCHAR AS today, (t - INTERVAL 1 DAY)::DATE::VARCHAR AS yesterday, (t - INTERVAL 6 DAY)::DATE::VARCHAR AS week, date_trunc('week', t)::DATE::VARCHAR AS monday, date_trunc('month', t)::DATE::VARCHAR AS month FROM x")
def relative_days(spark: SparkSession, d: str) -> DataFrame:
    """What today, yesterday, this week and this month were at every message, in a time zone eight hours ahead."""
    t = messages(spark, d).where("created_at IS NOT NULL").select(F.col("created_at").cast("timestamp").alias("t"))
    start = lambda w: X.resolved_range(F.lit(w), F.col("t"), "Asia/Shanghai")["start"].cast("string")
    return t.select(start("today").alias("today"), start("yesterday").alias("yesterday"), start("last 7 days").alias("week"), start("this week").alias("monday"), start("this month").alias("month")).distinct()


@query("args_hashes", "SELECT count(*) AS calls, count(DISTINCT (source_type, chunk_type, doc_id)) AS distinct_calls FROM blocks")
def args_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Equal arguments have one hash, different ones others."""
    return table(spark, d, "blocks").select(X.args_hash("source_type", "doc_id", "chunk_type").alias("h")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("h").alias("distinct_calls"))


@query("metadata_maps", "SELECT block_id, ((heading_path IS NOT NULL)::INT + (platform IS NOT NULL)::INT + (message_role IS NOT NULL)::INT + (image_path IS NOT NULL)::INT) AS keys FROM blocks")
def metadata_maps(spark: SparkSession, d: str) -> DataFrame:
    """Metadata as a map without nulls."""
    m = F.create_map(*[x for c in ("heading_path", "platform", "message_role", "image_path") for x in (F.lit(c), F.col(c))])
    return table(spark, d, "blocks").select("block_id", F.size(X.without_nulls(m)).alias("keys"))


@query("document_titles", r"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_extract(regexp_extract(text, '^(?s)---[ \t]*\n(.*?)\n---', 1), '(?m)^title:[ \t]*(.*)$', 1), '^["'']|["'']$', '', 'g')), ''), nullif(trim(regexp_extract(text, '(?m)^# +([^\n]*[^\s#])[ \t]*#*$', 1)), '')) AS title FROM documents WHERE text IS NOT NULL""")
def document_titles(spark: SparkSession, d: str) -> DataFrame:
    """The title of every document, from its front matter or its first heading."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.document_title(F.col("text")).alias("title"))


@query("front_matter")
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the front matter of every document that has one (tested on cases)."""
    m = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.front_matter(F.col("text")).alias("m")).where("size(m) > 0")
    return m.select("doc_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"))


@query("query_prefixes", "SELECT id, 'Instruct: Given a web search query, retrieve relevant passages that answer the query' || chr(10) || 'Query:' || question AS embedded FROM eval_questions")
def query_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Questions as one family of embedding models wants them."""
    return table(spark, d, "eval_questions").select("id", X.embedding_query(F.col("question"), "Qwen3-Embedding-8B").alias("embedded"))


@query("lexical_texts", r"SELECT block_id, md5(trim(concat_ws(' ', regexp_replace(list_last(string_split(coalesce(source_file, ''), '/')), '\.(?:md|markdown|mdx|txt)$', '', 'i'), heading_path, text))) AS h FROM blocks WHERE text IS NOT NULL")
def lexical_texts(spark: SparkSession, d: str) -> DataFrame:
    """What of a block the lexical index reads: title, heading and text."""
    return table(spark, d, "blocks").where("text IS NOT NULL").select("block_id", F.md5(F.trim(F.concat_ws(" ", N.stem(F.coalesce("source_file", F.lit(""))), "heading_path", "text")).cast("binary")).alias("h"))


@query("public_payloads", "SELECT DISTINCT block_id, list_last(string_split(source_file, '/')) AS name, heading_path, substring(text, 1, 240) AS snippet FROM blocks WHERE block_id IS NOT NULL")
def public_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What of a block may leave the engine: listed columns, the file's name without its folder, the first 240 characters."""
    return table(spark, d, "blocks").where("block_id IS NOT NULL").select("block_id", F.element_at(F.split("source_file", "/"), -1).alias("name"), "heading_path", F.substring("text", 1, 240).alias("snippet")).distinct()


@query("focused_windows")
def focused_windows(spark: SparkSession, d: str) -> DataFrame:
    """Where in each document the window with the most of three terms begins (tested on cases)."""
    terms = F.array(F.lit("glossary"), F.lit("budget"), F.lit("标题"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.focused_offset(F.col("text"), terms, 300).alias("start"))


# ---- streams


@query("event_tail", "WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_seq FROM events), e AS (SELECT user_id, min(event_seq) AS stop FROM s WHERE event_type = 'purchase' AND event_seq > 2 GROUP BY user_id) SELECT s.user_id, event_seq, event_type FROM s LEFT JOIN e ON s.user_id = e.user_id WHERE event_seq > 2 AND (stop IS NULL OR event_seq <= stop)")
def event_tail(spark: SparkSession, d: str) -> DataFrame:
    """A reader of every log after its second event up to the first purchase; every event is delivered twice."""
    numbered = table(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("event_seq"), "event_type")
    path = scratch_path(spark, "log")
    numbered.write.parquet(path)
    log = lambda: event_log.read_table(spark, path)
    return event_log.run(spark, event_log.tail(log().unionByName(log()), "user_id", "event_seq", "event_type", 2, ["purchase"]), "tail")


@query("committed_answers", "SELECT 'op1' AS operation, count(DISTINCT message_id) AS messages FROM conversation_messages WHERE message_id IS NOT NULL UNION ALL SELECT 'op2', count(DISTINCT message_id) FROM history_messages WHERE message_id IS NOT NULL")
def committed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Two operations, the first committed twice: every table has each operation's rows once."""
    path = scratch_path(spark, "commits")
    one = table(spark, d, "conversation_messages").where("message_id IS NOT NULL").select("message_id").distinct()
    two = messages(spark, d).where("message_id IS NOT NULL").select("message_id").distinct()
    for op, rows in (("op1", one), ("op1", one), ("op2", two)):
        ingest.commit_once(spark, {"messages": rows, "status": rows.limit(1)}, path, op)
    return ingest.committed(spark, path, "messages").groupBy("operation").agg(F.countDistinct("message_id").alias("messages"))


@query("retry_queue", "SELECT CASE WHEN length(description) % 3 = 0 THEN 'failed' ELSE 'done' END AS state, CASE WHEN length(description) % 3 = 0 THEN 3 ELSE 1 END AS attempts, count(*) AS n FROM (SELECT content_hash, min(description) AS description FROM image_descriptions WHERE content_hash IS NOT NULL AND description IS NOT NULL GROUP BY content_hash) GROUP BY ALL")
def retry_queue(spark: SparkSession, d: str) -> DataFrame:
    """A queue after four passes: what fails is tried three times, the rest once (a third of the descriptions fail)."""

    def work(text: str) -> str:
        if len(text) % 3 == 0:
            raise ValueError
        return text.upper()

    q = table(spark, d, "image_descriptions").where("content_hash IS NOT NULL AND description IS NOT NULL").groupBy(F.col("content_hash").alias("key")).agg(F.min("description").alias("payload")).select("key", "payload", F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("result"))
    for _ in range(4):
        q = ingest.attempt(q, work)
    return q.groupBy("state", "attempts").agg(F.count(F.lit(1)).alias("n"))


@query("ordered_map", "SELECT id, length(question) AS n FROM eval_questions WHERE question IS NOT NULL")
def ordered_map(spark: SparkSession, d: str) -> DataFrame:
    """Work on every question in at most four tasks at once; results in order again."""
    out = ingest.ordered_map(table(spark, d, "eval_questions").where("question IS NOT NULL"), "id", "question", lambda s: str(len(s)), 4)
    return out.select("id", F.col("result").cast("int").alias("n"))


@query("keyed_rows", "SELECT id, category, status FROM (SELECT id, arg_max(row(category, status), row(updated_at IS NOT NULL, updated_at, coalesce(category, ''), coalesce(status, ''))) AS r, r[1] AS category, r[2] AS status FROM memories WHERE id IS NOT NULL GROUP BY id) WHERE status = 'active' ORDER BY id")
def keyed_rows(spark: SparkSession, d: str) -> DataFrame:
    """A keyed table written in two versions and read back: the latest row of each key, those that are active."""
    from tessera.sources import files

    m = table(spark, d, "memories").where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct(F.col("updated_at").isNotNull().alias("t"), "updated_at", F.coalesce("category", F.lit("")).alias("c"), F.coalesce("status", F.lit("")).alias("s"), "category", "status")).alias("r")).select("id", "r.category", "r.status")
    path = scratch_path(spark, "keyed")
    files.write_keyed(spark, m.withColumn("status", F.lit("old")), path, "id", "first")
    for _ in range(2):
        files.write_keyed(spark, m, path, "id", "second")
    return files.read_keyed(spark, path).where("status = 'active'")


@query("short_context_wide", """WITH b AS (SELECT block_id, any_value(doc_id) AS doc_id, any_value(heading_path) AS h, any_value(text) AS t, min(document_order) AS o, any_value(source_type) AS st FROM blocks WHERE text IS NOT NULL AND block_id IS NOT NULL GROUP BY block_id),
    s AS (SELECT * FROM b WHERE length(t) < 600 AND st = 'document' AND coalesce(h, '') <> '' AND o IS NOT NULL),
    n AS (SELECT s.block_id, s.t, x.t AS other, sum(length(x.t)) OVER (PARTITION BY s.block_id ORDER BY abs(x.o - s.o), x.o, x.block_id) - length(x.t) AS before FROM s JOIN b x ON s.doc_id = x.doc_id AND s.h = x.h AND s.block_id <> x.block_id AND x.o IS NOT NULL)
    SELECT block_id, least(3000, any_value(length(t)) + sum(length(other)))::BIGINT AS context_chars, count(*) AS siblings FROM n WHERE length(t) + before < 1500 GROUP BY block_id""")
def short_context_wide(spark: SparkSession, d: str) -> DataFrame:
    """Context for short blocks with wider limits (short_context's find nothing here): under 600 characters, to 1,500, 3,000 at most."""
    return catalog.short_context(table(spark, d, "blocks"), 600, 1500, 3000)
