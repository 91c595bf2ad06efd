"""Queries: catalog lookup, hybrid search, reranking, graded quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import entries as N
from tessera.operators import evaluate, hybrid, lexical, quality, rerank
from tessera.plans import search as S
from tessera.plans.catalog import query
from tessera.session import cut
from tessera.tables import table

# ---- the catalog

STEM = r"regexp_replace(list_last(string_split(coalesce(source_file, ''), '/')), '\.(?:md|markdown|mdx|txt)$', '', 'i')"
NORM = lambda c: T.catalog_text_sql(c)


def tokens_sql(c: str) -> str:
    """The catalog's tokens of an SQL text that is in catalog form."""
    runs = f"regexp_extract_all({c}, '[{T.CJK}]+')"
    n = lambda k: f"flatten(list_transform({runs}, lambda r: list_transform(generate_series(1, length(r) - {k - 1}), lambda i: substring(r, i::BIGINT, {k}))))"
    return f"list_distinct(list_concat(list_concat(regexp_extract_all({c}, '[a-z0-9][a-z0-9_.\\-]*'), {n(2)}), list_concat({n(3)}, list_filter({runs}, lambda r: length(r) = 1))))"


def runs_sql(c: str, k: int) -> str:
    return f"list_distinct(flatten(list_transform(regexp_extract_all({c}, '[{T.CJK}]+'), lambda r: list_transform(generate_series(1, length(r) - {k - 1}), lambda i: substring(r, i::BIGINT, {k})))))"


LOW = ", ".join(T.quoted(x) for x in N.LOW_LABELS)
ENTRIES = f"""
nm AS (SELECT doc_id, min({STEM}) AS name FROM blocks WHERE source_type = 'document' AND doc_id IS NOT NULL GROUP BY doc_id),
al AS (SELECT doc_id, heading_path, unnest(CASE WHEN json_valid(heading_aliases) THEN from_json(heading_aliases, '["VARCHAR"]') END) AS a FROM blocks WHERE source_type = 'document' AND doc_id IS NOT NULL AND coalesce(heading_path, '') <> ''),
hd AS (SELECT DISTINCT doc_id, heading_path FROM blocks WHERE source_type = 'document' AND doc_id IS NOT NULL AND coalesce(heading_path, '') <> ''),
ag AS (SELECT doc_id, heading_path, list(DISTINCT {NORM('a')}) AS aliases FROM al WHERE a IS NOT NULL GROUP BY ALL),
en AS (SELECT 'document' AS kind, doc_id, '' AS heading_path, {NORM('name')} AS term, []::VARCHAR[] AS aliases, '' AS h, {NORM('name')} AS title FROM nm
       UNION ALL SELECT 'heading', hd.doc_id, hd.heading_path, {NORM("list_last(string_split(hd.heading_path, ' > '))")}, coalesce(list_sort(list_filter(ag.aliases, lambda a: a <> '')), []), {NORM('hd.heading_path')}, {NORM('name')} FROM hd JOIN nm USING (doc_id) LEFT JOIN ag ON hd.doc_id = ag.doc_id AND hd.heading_path = ag.heading_path),
et AS (SELECT *, {tokens_sql("concat_ws(' ', term, array_to_string(aliases, ' '), h, title)")} AS tokens, CASE WHEN kind = 'document' THEN title WHEN term <> '' THEN term ELSE h END AS label FROM en),
qs AS (SELECT id AS query_id, {NORM('question')} AS q FROM eval_questions),
qt AS (SELECT *, {tokens_sql('q')} AS qtokens, {runs_sql('q', 4)} AS q4, {runs_sql('q', 2)} AS q2 FROM qs WHERE q <> ''),
sc AS (SELECT query_id, kind, doc_id, heading_path, CASE
   WHEN term <> '' AND term = q THEN 1000 WHEN list_contains(aliases, q) THEN 900
   WHEN term <> '' AND length(q) >= 2 AND contains(q, term) AND (kind = 'document' OR length(term) >= 3) AND term NOT IN ({LOW}) THEN 800
   WHEN len(list_filter(aliases, lambda a: length(a) >= 3 AND contains(q, a))) > 0 THEN 700
   WHEN title <> '' AND (contains(q, title) OR contains(title, q)) THEN 500
   WHEN h <> '' AND (contains(q, h) OR contains(h, q)) AND (kind = 'document' OR (length(h) >= 3 AND h NOT IN ({LOW}))) THEN 400
   WHEN len(list_filter(q4, lambda g: contains(label, g))) > 0 AND (kind = 'document' OR label NOT IN ({LOW})) THEN 400 + least(30, len(list_filter(q2, lambda g: contains(label, g))))
   WHEN len(list_filter(qtokens, lambda t: contains(h, t))) > 0 THEN 300
   WHEN len(list_intersect(qtokens, tokens)) > 0 THEN 100 + least(99, len(list_intersect(qtokens, tokens))) ELSE 0 END AS score FROM et, qt),
ps AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN score >= 500 THEN 0 WHEN score >= 400 THEN 1 ELSE 2 END, score DESC, CASE kind WHEN 'heading' THEN 1 ELSE 2 END, doc_id, heading_path) AS position,
              count(*) OVER (PARTITION BY query_id) AS total FROM (SELECT DISTINCT * FROM sc WHERE score > 0))"""


def looked_up(spark: SparkSession, d: str) -> DataFrame:
    return N.ranked(N.lookup(N.entries(table(spark, d, "blocks")), S.questions(spark, d)))


@query("catalog_lookup", f"WITH {ENTRIES} SELECT query_id, position, kind, doc_id, heading_path, score FROM ps WHERE position <= 8")
def catalog_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The eight catalog entries that fit each question best, in bands (a top-k report)."""
    return looked_up(spark, d).where("position <= 8").select("query_id", "position", "kind", "doc_id", "heading_path", "score")


@query("catalog_page", f"WITH {ENTRIES} SELECT query_id, position, doc_id, heading_path, total, CASE WHEN total > 16 THEN 16 END AS next_cursor FROM ps WHERE position > 8 AND position <= 16")
def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the lookup, with the total and where the third begins."""
    return N.page(looked_up(spark, d), 8, 8).select("query_id", "position", "doc_id", "heading_path", "total", "next_cursor")


@query("catalog_labels", f"WITH {ENTRIES}, f AS (SELECT query_id, doc_id, min(position) AS first FROM ps WHERE position <= 8 GROUP BY ALL) SELECT query_id, doc_id, 'D' || row_number() OVER (PARTITION BY query_id ORDER BY first) AS label FROM f")
def catalog_labels(spark: SparkSession, d: str) -> DataFrame:
    """Short labels of the documents of a lookup, by first appearance."""
    return N.relabelled(looked_up(spark, d).where("position <= 8")).select("query_id", "doc_id", "label").distinct()


TEXTS = "tx AS (SELECT content_hash AS doc_id, min(text) AS text FROM documents WHERE content_hash IS NOT NULL AND text IS NOT NULL GROUP BY content_hash)"


def leaf_terms(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("source_type = 'document' AND doc_id IS NOT NULL AND coalesce(heading_path, '') <> ''")
    return b.select("doc_id", "heading_path", F.trim(F.element_at(T.heading_parts(F.col("heading_path")), -1)).alias("term")).distinct()


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("content_hash IS NOT NULL AND text IS NOT NULL").groupBy(F.col("content_hash").alias("doc_id")).agg(F.min("text").alias("text"))


MARKED = " OR ".join(f"contains(s, {T.quoted(m)})" for m in N.EXPLAINS)


@query("term_definitions", rf"""WITH {TEXTS}, t AS (SELECT DISTINCT doc_id, trim(list_last(string_split(heading_path, ' > '))) AS term FROM blocks WHERE source_type = 'document' AND doc_id IS NOT NULL AND coalesce(heading_path, '') <> ''),
    t1 AS (SELECT *, {NORM('term')} AS t FROM t), s0 AS (SELECT doc_id, regexp_split_to_array(text, '[。！？!?；;\n]+') AS a FROM tx), s1 AS (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS n FROM s0), s2 AS (SELECT doc_id, n, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM s1),
    m AS (SELECT t1.doc_id, term, arg_min(s, n) AS definition FROM t1 JOIN s2 ON t1.doc_id = s2.doc_id AND length(t) >= 2 AND contains({NORM('s')}, t) AND length(s) > length(term) AND ({MARKED}) GROUP BY ALL)
    SELECT t.doc_id, t.term, definition FROM t LEFT JOIN m ON t.doc_id = m.doc_id AND t.term = m.term""")
def term_definitions(spark: SparkSession, d: str) -> DataFrame:
    """For every leaf heading the first sentence of its document that explains it."""
    return N.definitions(leaf_terms(spark, d).select("doc_id", "term").distinct(), texts(spark, d))


def candidate_terms(spark: SparkSession, d: str) -> DataFrame:
    """Term candidates as a model might propose them: with a snippet of the text, of another text, and with a foreign heading."""
    t = leaf_terms(spark, d)
    even = F.pmod(F.length("term"), F.lit(3))
    return t.select("term", "doc_id", F.when(even == 1, F.concat("heading_path", F.lit(" > ?"))).otherwise(F.col("heading_path")).alias("heading_path"), F.when(even == 2, F.concat("term", F.lit("??"))).otherwise(F.col("term")).alias("snippet"))


@query("valid_terms", f"""WITH {TEXTS}, hd AS (SELECT DISTINCT doc_id, heading_path FROM blocks WHERE source_type = 'document' AND doc_id IS NOT NULL AND coalesce(heading_path, '') <> ''),
    t AS (SELECT DISTINCT doc_id, heading_path, trim(list_last(string_split(heading_path, ' > '))) AS term FROM hd),
    c AS (SELECT term, doc_id, CASE WHEN length(term) % 3 = 1 THEN heading_path || ' > ?' ELSE heading_path END AS heading_path, CASE WHEN length(term) % 3 = 2 THEN term || '??' ELSE term END AS snippet FROM t),
    v AS (SELECT c.* FROM c JOIN hd USING (doc_id, heading_path) JOIN tx USING (doc_id) WHERE length(term) > 0 AND contains(text, snippet)),
    o AS (SELECT *, row_number() OVER (PARTITION BY {NORM('term')} ORDER BY term, doc_id, heading_path) AS n FROM v)
    SELECT term, doc_id, heading_path FROM o WHERE n = 1 ORDER BY term, doc_id, heading_path LIMIT 400""")
def valid_terms(spark: SparkSession, d: str) -> DataFrame:
    """Proposed terms that hold: known document and heading, snippet in the text, one of equal terms (400 at most, the catalog's size)."""
    return N.valid_terms(candidate_terms(spark, d), N.entries(table(spark, d, "blocks")), texts(spark, d))


@query("tool_catalog", """WITH b AS (SELECT doc_id, block_id, min(document_order) AS o, min(heading_path) AS h, min(source_file) AS f FROM blocks WHERE doc_id IS NOT NULL AND block_id IS NOT NULL GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o NULLS LAST, block_id) AS n FROM b)
    SELECT doc_id, count(DISTINCT nullif(h, '')) AS headings, string_agg(block_id, ',' ORDER BY n) FILTER (n <= 10) AS positions, arg_min(f, n) AS source_file FROM n GROUP BY doc_id""")
def tool_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Headings, the first ten positions and the file of every document."""
    return N.tool_catalog(table(spark, d, "blocks"))


@query("scope_resolution", rf"""WITH t AS (SELECT doc_id, regexp_replace(list_last(string_split(path, '/')), '\.(?:md|markdown|mdx|txt)$', '', 'i') AS title FROM documents WHERE path IS NOT NULL), n AS (SELECT DISTINCT doc_id, {NORM('title')} AS title FROM t WHERE length({NORM('title')}) >= 2), q AS (SELECT doc_id AS query_id, {NORM("'What does ' || title || ' say about it?'")} AS q FROM t)
    SELECT query_id, min(doc_id) AS doc_id FROM q JOIN n ON contains(q.q, n.title) GROUP BY query_id HAVING count(DISTINCT doc_id) = 1""")
def scope_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The one document that a question names: here a question for each title (quoted parts and shared characters, the other two
    rules, are tested on cases)."""
    titles = table(spark, d, "documents").where("path IS NOT NULL").select("doc_id", N.stem(F.col("path")).alias("title"))
    asked = titles.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("What does "), "title", F.lit(" say about it?")).alias("question"))
    return N.resolve_scope(asked, titles)


# ---- hybrid search

VECTOR = lambda c: f"list_transform(generate_series(0, {hybrid.DIM - 1}), lambda i: len(list_filter({c}, lambda s: s = i))::DOUBLE)"
SLOTS = lambda t: f"list_transform({t}, lambda x: ('0x' || substring(md5(x), 1, 2))::INT % {hybrid.DIM})"
HYBRID = f"""{S.CB}, {S.BLOCK_TOKENS}, {S.STATS}, {S.POSTINGS}, {S.QUERIES_SQL}, {S.SCORED},
lex AS (SELECT query_id, k AS block_id, rank AS lexical_rank, score AS bm25_score FROM r WHERE rank <= 50),
ab AS (SELECT block_id, any_value(text) AS text FROM blocks WHERE block_id IS NOT NULL GROUP BY block_id),
bv0 AS (SELECT block_id, {VECTOR(SLOTS(T.tokens_sql('text')))} AS v FROM ab), qv0 AS (SELECT query_id, {VECTOR(SLOTS('seq'))} AS v FROM q0),
bv AS (SELECT block_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM bv0 WHERE list_sum(v) > 0), qv AS (SELECT query_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM qv0 WHERE list_sum(v) > 0),
dn0 AS (SELECT query_id, block_id, round(list_cosine_similarity(qv.v, bv.v), 6) AS similarity FROM qv, bv),
dn1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, block_id) AS rank FROM dn0),
cm AS (SELECT block_id, min(canonical_id) AS canonical_id FROM b1 GROUP BY block_id),
dn AS (SELECT query_id, canonical_id AS block_id, min(rank) AS dense_rank, max(similarity) AS dense_similarity FROM dn1 JOIN cm USING (block_id) WHERE rank <= 400 GROUP BY ALL),
hy AS (SELECT coalesce(dn.query_id, lex.query_id) AS query_id, coalesce(dn.block_id, lex.block_id) AS block_id, dense_rank, dense_similarity, lexical_rank, bm25_score, round(coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + lexical_rank), 0), 9) AS rrf_score FROM dn FULL JOIN lex ON dn.query_id = lex.query_id AND dn.block_id = lex.block_id)"""


@query("hybrid_candidates", f"WITH {HYBRID} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, block_id) AS rrf_rank FROM hy")
def hybrid_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Dense and lexical search of every question in its own wording, over canonical blocks, fused."""
    f = hybrid.fuse(hybrid.routes(spark, table(spark, d, "blocks"), S.questions(spark, d), variants=False))
    return f.select("query_id", "block_id", "dense_rank", "dense_similarity", "lexical_rank", "bm25_score", "rrf_score", "rrf_rank")


@query("hybrid_context")
def hybrid_context(spark: SparkSession, d: str) -> DataFrame:
    """The context of every question: all wordings, gates, anchors with reserves, quotas (order-dependent; tested on cases)."""
    return hybrid.retrieve(spark, table(spark, d, "blocks"), S.questions(spark, d))[0]


@query("hybrid_trace")
def hybrid_trace(spark: SparkSession, d: str) -> DataFrame:
    """What became of every candidate and why; neither texts nor paths."""
    return hybrid.retrieve(spark, table(spark, d, "blocks"), S.questions(spark, d))[1]


@query("scoped_search", f"""WITH {S.CB}, {S.BLOCK_TOKENS}, {S.STATS}, {S.POSTINGS}, {S.QUERIES_SQL}, {S.SCORED},
    inside AS (SELECT block_id FROM (SELECT block_id, any_value(source_type) AS st FROM blocks GROUP BY block_id) WHERE st = 'document'), own AS (SELECT query_id, k AS block_id, score FROM r WHERE k IN (SELECT block_id FROM inside))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, block_id) AS rank FROM own) WHERE rank <= 20""")
def scoped_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical search inside a scope: the statistics are of the whole corpus, hits and ranks of the scope."""
    b = table(spark, d, "blocks")
    from tessera.operators import fusion

    ids = fusion.canonical(b).select(F.col("canonical_id").alias("block_id")).distinct()
    whole = b.where("block_id IS NOT NULL").groupBy("block_id").agg(F.first("text", ignorenulls=True).alias("text"), F.first("source_type").alias("st")).join(ids, "block_id", "left_semi")
    return lexical.search(whole, "block_id", "text", S.questions(spark, d), "query_id", "question", 20, whole.where("st = 'document'").select("block_id")).select("query_id", "block_id", "score", "rank")


@query("scope_check", "SELECT content_hash AS doc_id FROM documents WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (content_hash IN (SELECT doc_id FROM blocks WHERE doc_id IS NOT NULL)) = 0")
def scope_check(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a scope that the index does not know."""
    docs = table(spark, d, "documents").where("content_hash IS NOT NULL").select(F.col("content_hash").alias("doc_id"))
    return hybrid.unresolved(table(spark, d, "blocks"), docs)


# ---- reranking

HITS = f"WITH {S.CB}, {S.BLOCK_TOKENS}, {S.STATS}, {S.POSTINGS}, {S.QUERIES_SQL}, {S.SCORED}, hit AS (SELECT query_id, k AS block_id, score, coverage, rank FROM r WHERE rank <= 20)"


def hits(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    from tessera.operators import fusion

    b = table(spark, d, "blocks")
    ids = fusion.canonical(b).select(F.col("canonical_id").alias("block_id")).distinct()
    whole = b.where("block_id IS NOT NULL").groupBy("block_id").agg(F.first("text", ignorenulls=True).alias("text")).join(ids, "block_id", "left_semi")
    return lexical.search(whole, "block_id", "text", S.questions(spark, d), "query_id", "question", k)


def about(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").where("block_id IS NOT NULL").groupBy("block_id").agg(F.min("source_file").alias("name"), F.min("heading_path").alias("heading"), F.min("text").alias("text"), F.min("dedup_key").alias("dedup_key"), F.min("doc_id").alias("doc_id"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).join(about(spark, d), "block_id").join(S.questions(spark, d), "query_id")
    text = rerank.ranking_text(F.col("name"), F.col("heading"), F.col("text"))
    return h.select("query_id", F.col("block_id").alias("candidate_id"), F.lit("all").alias("scope_id"), F.when(F.col("dedup_key").isNull(), "old").otherwise("r1").alias("index_revision"), text.alias("ranking_text"), F.sha2(text, 256).alias("payload_hash"), "question", "rank")


REQUESTS = f"""{HITS}, ab AS (SELECT block_id, min(source_file) AS name, min(heading_path) AS heading, min(text) AS text, min(dedup_key) AS dedup_key FROM blocks WHERE block_id IS NOT NULL GROUP BY block_id),
rq AS (SELECT query_id, block_id AS candidate_id, CASE WHEN dedup_key IS NULL THEN 'old' ELSE 'r1' END AS index_revision, '文档：' || coalesce(name, '') || chr(10) || '标题：' || coalesce(heading, '') || chr(10) || '内容：' || coalesce(text, '') AS ranking_text, rank FROM hit JOIN ab USING (block_id))"""


@query("rerank_checks", f"{REQUESTS} SELECT q.id AS query_id, count(rq.candidate_id) AS candidates, CASE WHEN count(rq.candidate_id) = 0 THEN 'empty' WHEN bool_or(index_revision = 'old') THEN 'version_changed' ELSE 'ok' END AS status FROM eval_questions q LEFT JOIN rq ON q.id = rq.query_id GROUP BY q.id")
def rerank_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether the batch of every question holds its contract (blocks without a fingerprint count as of another revision)."""
    s = S.questions(spark, d).select("query_id", F.lit("all").alias("scope_id"), F.lit("r1").alias("index_revision"))
    return rerank.checked(requests(spark, d), s)


@query("ranking_texts", f"{REQUESTS} SELECT query_id, candidate_id, md5(ranking_text) AS h FROM rq")
def ranking_texts(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("query_id", "candidate_id", F.md5(F.col("ranking_text").cast("binary")).alias("h"))


@query("rerank_scores", f"{REQUESTS}, sc AS (SELECT query_id, candidate_id, rank, list_distinct({T.tokens_sql('question')}) AS q, list_distinct({T.tokens_sql('ranking_text')}) AS t FROM rq JOIN eval_questions e ON e.id = query_id), s2 AS (SELECT query_id, candidate_id, rank, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END, 6) AS score FROM sc) SELECT query_id, candidate_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 1 / (60 + rank) DESC, candidate_id) AS final_rank FROM s2")
def rerank_scores(spark: SparkSession, d: str) -> DataFrame:
    """The default scorer over every batch, in final order."""
    s = requests(spark, d).select("query_id", "candidate_id", F.round(rerank.coverage_score(F.col("question"), F.col("ranking_text")), 6).alias("score"), (1 / (60 + F.col("rank"))).alias("rrf_score"))
    return rerank.ordered(s).select("query_id", "candidate_id", "score", "final_rank")


@query("rerank_answers", f"{REQUESTS}, b AS (SELECT query_id, count(*) AS n, bool_or(length(candidate_id) % 7 = 0) AS lost, bool_or(rank = 20) AS long FROM rq GROUP BY query_id) SELECT query_id, CASE WHEN lost THEN 'missing' WHEN long THEN 'out_of_range' ELSE 'ok' END AS status FROM b")
def rerank_answers(spark: SparkSession, d: str) -> DataFrame:
    """Whether the answers of a provider are complete: here one that leaves candidates out (by the length of their id) and gives the
    twentieth a score above one."""
    r = requests(spark, d)
    a = r.where("length(candidate_id) % 7 <> 0").select("query_id", "candidate_id", F.when(F.col("rank") == 20, 1.5).otherwise(0.5).alias("score"))
    return rerank.answered(r, a)


@query("rerank_window", f"{HITS}, tk AS (SELECT query_id, block_id, rank, (length(text) + 1) // 2 AS tokens FROM hit JOIN cb USING (block_id)), sm AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank, block_id ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY query_id ORDER BY rank, block_id) AS n FROM tk) SELECT query_id, block_id AS candidate_id FROM sm WHERE total <= 3000 OR n <= 3")
def rerank_window(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that fit 3,000 tokens together (two characters a token), three at least."""
    c = hits(spark, d).join(about(spark, d).select("block_id", F.expr("(length(text) + 1) div 2").alias("tokens")), "block_id").select("query_id", F.col("rank").alias("rrf_rank"), F.col("block_id").alias("candidate_id"), "tokens")
    return rerank.shrunk(c, 3000, 3).select("query_id", "candidate_id")


VIEWS = f"""{HITS}, n AS (SELECT query_id, block_id, coverage AS score, length(text) AS n FROM hit JOIN cb USING (block_id) WHERE length(text) >= 4),
vw AS (SELECT query_id, block_id || '#' || k AS candidate_id, block_id, CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN n // 4 ELSE n // 3 END AS a, CASE k WHEN 0 THEN n WHEN 1 THEN n // 2 WHEN 2 THEN n // 2 ELSE n - n // 5 END AS b, round(score / (1 + k), 6) AS score FROM n, (VALUES (0), (1), (2), (3)) x(k) WHERE k > 0 OR n < 1200)"""


@query("rerank_classes", f"{VIEWS}, cl AS (SELECT v.query_id, v.candidate_id, v.a, v.b, v.score, first(o.candidate_id ORDER BY o.a - o.b, o.a, o.candidate_id) AS class_id FROM vw v JOIN vw o ON v.query_id = o.query_id AND v.block_id = o.block_id AND o.a <= v.a AND v.b <= o.b GROUP BY ALL) SELECT query_id, candidate_id, class_id, row_number() OVER (PARTITION BY query_id, class_id ORDER BY score DESC, a - b, candidate_id) = 1 AS represents FROM cl")
def rerank_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of views that contain one another, with their representative (whole short blocks, heads, quarters and middles)."""
    n = hits(spark, d).join(about(spark, d).select("block_id", F.length("text").alias("n")), "block_id").where("n >= 4").withColumn("k", F.explode(F.array(*map(F.lit, range(4))))).where("k > 0 OR n < 1200")
    v = n.select("query_id", F.concat("block_id", F.lit("#"), F.col("k").cast("string")).alias("candidate_id"), "block_id", F.expr("CASE WHEN k <= 1 THEN 0 WHEN k = 2 THEN n div 4 ELSE n div 3 END").alias("start"), F.expr("CASE WHEN k = 0 THEN n WHEN k <= 2 THEN n div 2 ELSE n - n div 5 END").alias("stop"), F.round(F.col("coverage") / (1 + F.col("k")), 6).alias("score"))
    return rerank.classes(v).select("query_id", "candidate_id", "class_id", "represents")


@query("rerank_outcome", f"{REQUESTS}, b AS (SELECT q.id AS query_id, count(rq.candidate_id) AS n, coalesce(bool_or(index_revision = 'old'), false) AS old, count(*) FILTER (rank = 1) AS kept FROM eval_questions q LEFT JOIN rq ON q.id = rq.query_id GROUP BY q.id) SELECT query_id, CASE WHEN n = 0 THEN 'empty' WHEN old THEN 'failed' WHEN kept = 0 THEN 'empty' ELSE 'filtered' END AS status FROM b")
def rerank_outcome(spark: SparkSession, d: str) -> DataFrame:
    """The status of the pipeline for every question: nothing is passed on unfiltered."""
    r = cut(spark, requests(spark, d), "requests")
    s = S.questions(spark, d).select("query_id", F.lit("all").alias("scope_id"), F.lit("r1").alias("index_revision"))
    answers = r.select("query_id", "candidate_id", F.lit(0.5).alias("score"))
    return rerank.outcome(rerank.checked(r, s), rerank.answered(r, answers), r.select("query_id", (F.col("rank") == 1).alias("selected")))


@query("corpus_drift", """WITH k AS (SELECT substring(sha256(block_id), 1, 2) || ':' || sha256(string_agg(DISTINCT block_id, chr(10) ORDER BY block_id)) AS k FROM blocks WHERE block_id IS NOT NULL GROUP BY substring(sha256(block_id), 1, 2)), r AS (SELECT sha256(string_agg(k, chr(10) ORDER BY k)) AS revision FROM k)
    SELECT chunk_type AS profile, count(*) FILTER (block_id IS NOT NULL) > 0 AND chunk_type <> 'text' AS needs_validation FROM blocks, r WHERE chunk_type IS NOT NULL GROUP BY chunk_type""")
def corpus_drift(spark: SparkSession, d: str) -> DataFrame:
    """Profiles made on another corpus need validation: here one for each type of block, of which that of texts was made on all."""
    b = table(spark, d, "blocks")
    now = rerank.corpus_identity(b)
    p = b.where("chunk_type IS NOT NULL").select(F.col("chunk_type").alias("profile")).distinct().join(F.broadcast(now)).select("profile", F.when(F.col("profile") == "text", F.col("revision")).otherwise(F.lit("other")).alias("corpus_revision"))
    return rerank.drifted(p, b).select("profile", "needs_validation")


# ---- graded quality

GRADES = f"""WITH {S.DOC_TOKENS}, {S.STATS}, {S.POSTINGS}, {S.QUERIES_SQL}, {S.SCORED},
vw AS (SELECT query_id, k AS key, rank, rank <= 8 AS returned, length(text) AS chars FROM r JOIN documents d ON d.doc_id = r.k WHERE rank <= 50),
sn AS (SELECT id AS query_id, type, unnest(evidence) AS e, generate_subscripts(evidence, 1) AS ord FROM eval_questions),
s1 AS (SELECT query_id, type, ord, e.snippet AS s, e.doc AS doc FROM sn),
g3 AS (SELECT DISTINCT v.query_id, v.key, ord, 3 AS grade, ord::VARCHAR AS grp FROM vw v JOIN s1 USING (query_id) JOIN documents d ON d.doc_id = v.key AND contains(d.text, s1.s)),
g1 AS (SELECT DISTINCT v.query_id, v.key, 100 AS ord, CASE WHEN d.source = 'journal' THEN 0 ELSE 1 END AS grade, NULL AS grp FROM vw v JOIN documents d ON d.doc_id = v.key WHERE d.lang IS NOT NULL),
gr AS (SELECT * FROM g3 UNION ALL SELECT * FROM g1),
hn AS (SELECT DISTINCT v.query_id, v.key FROM vw v JOIN eval_questions q ON q.id = v.query_id JOIN s1 ON s1.query_id <> v.query_id AND s1.type = q.type JOIN documents d ON d.doc_id = v.key AND contains(d.text, s1.s) WHERE (v.query_id, v.key) NOT IN (SELECT (query_id, key) FROM g3)),
cs AS (SELECT id AS query_id, type AS family, length(id) % 2 = 0 AS even, answerable AS needs_answer, len(evidence) AS groups FROM eval_questions),
jd AS (SELECT v.*, (SELECT first(grade ORDER BY ord) FROM gr WHERE gr.query_id = v.query_id AND gr.key = v.key) AS grade, (v.query_id, v.key) IN (SELECT (query_id, key) FROM hn) AS hard FROM vw v),
pc AS (SELECT query_id, count(*) FILTER (returned) AS returned, count(*) FILTER (returned AND grade >= 2) AS relevant, count(*) FILTER (returned AND grade IS NULL) AS unjudged, count(*) FILTER (hard) AS hard_scored, count(*) FILTER (returned AND hard) AS hard_returned,
       coalesce(sum(chars) FILTER (returned AND grade IS NOT NULL), 0) AS judged_chars, coalesce(sum(chars) FILTER (returned AND grade <= 1), 0) AS irrelevant_chars FROM jd GROUP BY query_id),
mt AS (SELECT query_id, count(DISTINCT grp) AS met_scored, count(DISTINCT grp) FILTER (returned) AS met_returned FROM vw JOIN g3 USING (query_id, key) GROUP BY query_id),
ms AS (SELECT cs.*, coalesce(returned, 0) AS returned, coalesce(relevant, 0) AS relevant, coalesce(unjudged, 0) AS unjudged, coalesce(hard_scored, 0) AS hard_scored, coalesce(hard_returned, 0) AS hard_returned, coalesce(judged_chars, 0) AS judged_chars, coalesce(irrelevant_chars, 0) AS irrelevant_chars, coalesce(met_scored, 0) AS met_scored, coalesce(met_returned, 0) AS met_returned FROM cs LEFT JOIN pc USING (query_id) LEFT JOIN mt USING (query_id)),
mx AS (SELECT *, CASE WHEN returned > 0 AND unjudged = 0 THEN relevant / returned END AS precision, CASE WHEN groups > 0 THEN met_returned / groups END AS recall, CASE WHEN groups > 0 THEN met_scored / groups END AS coverage, CASE WHEN NOT needs_answer THEN returned > 0 END AS empty_false FROM ms),
rp AS (SELECT CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(even) = 0 THEN 'even' ELSE 'all' END AS level, CASE WHEN grouping(family) = 0 THEN coalesce(family, '') WHEN grouping(even) = 0 THEN even::VARCHAR ELSE '' END AS value, count(*) AS cases, round(avg(precision), 6) AS precision_macro,
       round(CASE WHEN sum(returned) FILTER (precision IS NOT NULL) > 0 THEN sum(relevant) FILTER (precision IS NOT NULL) / sum(returned) FILTER (precision IS NOT NULL) END, 6) AS precision_micro, round(avg(recall), 6) AS recall_macro, round(CASE WHEN sum(groups) > 0 THEN sum(met_returned) / sum(groups) END, 6) AS recall_micro, round(avg(coverage), 6) AS candidate_coverage,
       round(CASE WHEN sum(hard_scored) > 0 THEN sum(hard_returned) / sum(hard_scored) END, 6) AS hard_negative_rate, round(avg(empty_false::INT), 6) AS empty_false_context, round(CASE WHEN sum(judged_chars) > 0 THEN sum(irrelevant_chars) / sum(judged_chars) END, 6) AS irrelevant_char_ratio, sum(unjudged)::BIGINT AS unjudged FROM mx GROUP BY GROUPING SETS ((), (family), (even)))"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    """The lexical search of documents as cases: required is every evidence snippet; other documents are judged by their source
    (unjudged where the language is unknown); hard negatives hold a snippet of another item of the type."""
    docs, qs = table(spark, d, "documents"), table(spark, d, "eval_questions")
    views = lexical.search(docs, "doc_id", "text", S.questions(spark, d), "query_id", "question", 50).join(docs.select("doc_id", F.length("text").alias("chars"), "source", "lang"), "doc_id")
    views = cut(spark, views.select("query_id", F.col("doc_id").alias("key"), "rank", (F.col("rank") <= 8).alias("returned"), "chars", "source", "lang"), "views")
    sn = qs.select(F.col("id").alias("query_id"), "type", F.posexplode("evidence.snippet").alias("n", "s"))
    # evidence is a bounded query set: one pass over the texts finds every snippet
    held = cut(spark, evaluate.containing(docs, "doc_id", "text", sn.select("s").distinct().withColumn("sid", F.xxhash64("s")), "sid", "s"), "held")
    at = sn.withColumn("sid", F.xxhash64("s")).join(held, "sid").select(F.col("query_id").alias("owner"), "type", (F.col("n") + 1).alias("ord"), F.col("doc_id").alias("key"))
    g3 = views.join(at, (views["query_id"] == at["owner"]) & (views["key"] == at["key"])).select("query_id", views["key"], "ord", F.lit(3).alias("grade"), F.col("ord").cast("string").alias("grp")).distinct()
    g1 = views.where("lang IS NOT NULL").select("query_id", "key", F.lit(100).alias("ord"), F.when(F.col("source") == "journal", 0).otherwise(1).alias("grade"), F.lit(None).cast("string").alias("grp")).distinct()
    others = views.join(qs.select(F.col("id").alias("query_id"), "type"), "query_id").join(at.withColumnRenamed("key", "at_key").withColumnRenamed("type", "at_type"), (F.col("key") == F.col("at_key")) & (F.col("type") == F.col("at_type")) & (F.col("owner") != F.col("query_id"))).select("query_id", "key").distinct()
    hard = others.join(g3.select("query_id", "key"), ["query_id", "key"], "left_anti")
    cases = qs.select(F.col("id").alias("query_id"), F.col("type").alias("family"), (F.length("id") % 2 == 0).alias("even"), F.col("answerable").alias("needs_answer"), F.size("evidence").alias("groups"))
    return quality.by_case(views.select("query_id", "key", "rank", "returned", "chars"), g3.unionByName(g1), hard, cases)


@query("relevance_report", f"{GRADES} SELECT * FROM rp")
def relevance_report(spark: SparkSession, d: str) -> DataFrame:
    """Graded relevance over all cases, by family and by split, in one pass over grouping sets."""
    return quality.report(measured(spark, d), "family", "even")


@query("quality_gate", f"""{GRADES}, wh AS (SELECT *, level = 'all' AS whole FROM rp WHERE level IN ('all', 'family')),
    fl AS (SELECT level, value, array_to_string(list_filter([CASE WHEN whole AND unjudged > 0 THEN 'unjudged' END, CASE WHEN coalesce(precision_macro < CASE WHEN whole THEN 0.9 ELSE 0.85 END, whole) THEN 'precision' END, CASE WHEN coalesce(recall_macro < CASE WHEN whole THEN 0.95 ELSE 0.9 END, whole) THEN 'recall' END, CASE WHEN whole AND hard_negative_rate > 0.05 THEN 'hard_negatives' END, CASE WHEN whole AND coalesce(empty_false_context > 0, true) THEN 'empty_false_context' END], lambda x: x IS NOT NULL), '+') AS failed FROM wh)
    SELECT level, value, failed = '' AS passes, failed FROM fl""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the whole and every family pass the gate, and what failed."""
    return quality.gate(quality.report(measured(spark, d), "family"), "family")


@query("retrieval_bench", f"""WITH {S.DOC_TOKENS}, {S.STATS}, {S.POSTINGS}, {S.QUERIES_SQL}, {S.SCORED}, tg AS (SELECT DISTINCT q.query_id, d.doc_id FROM (SELECT id AS query_id, unnest(evidence).snippet AS s FROM eval_questions) q JOIN documents d ON contains(d.text, q.s)), wt AS (SELECT query_id, count(*) AS targets FROM tg GROUP BY query_id),
    ht AS (SELECT r.query_id, r.k, r.rank, content_hash, tg.doc_id IS NOT NULL AS rel FROM r JOIN documents d ON d.doc_id = r.k LEFT JOIN tg ON r.query_id = tg.query_id AND r.k = tg.doc_id WHERE rank <= 8),
    pq AS (SELECT query_id, min(rank) FILTER (rel) AS first, count(*) FILTER (rel) AS found, count(*) AS n, count(DISTINCT content_hash) AS texts, sum(CASE WHEN rel THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM ht GROUP BY query_id)
    SELECT wt.query_id, round(coalesce(1 / first, 0), 6) AS rr, round(coalesce(dcg / list_sum(list_transform(generate_series(1, least(targets, 8)), lambda i: 1 / log2(i + 1.0))), 0), 6) AS ndcg, round(coalesce(found / least(targets, 8), 0), 6) AS evidence, round(coalesce(1 - found / n, 0), 6) AS pollution, round(coalesce(1 - texts / n, 0), 6) AS duplicates FROM wt LEFT JOIN pq USING (query_id)""")
def retrieval_bench(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank, nDCG, evidence, pollution and duplicates of the first eight documents of every question with evidence."""
    docs, qs = table(spark, d, "documents"), table(spark, d, "eval_questions")
    targets = evaluate.containing(docs, "doc_id", "text", qs.select(F.col("id").alias("query_id"), F.explode("evidence.snippet").alias("s")), "query_id", "s").withColumnRenamed("doc_id", "key")
    top = lexical.search(docs, "doc_id", "text", S.questions(spark, d), "query_id", "question", 8).join(docs.select("doc_id", "content_hash"), "doc_id").select("query_id", F.col("doc_id").alias("key"), "rank", F.col("content_hash").alias("text_hash"))
    return quality.retrieval_bench(top, targets, targets.groupBy("query_id").agg(F.count(F.lit(1)).alias("targets")))
