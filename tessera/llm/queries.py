"""The pN_ queries and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import conversations, leakage, lookalikes, near_duplicates, packing, personal, reading_level, split
from tessera.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: split.found(table(s, d, "blocks")),
    "p1_split": lambda s, d: split.split_blocks(table(s, d, "blocks")),
    "p1_chunk_counts": lambda s, d: split.chunk_counts(table(s, d, "documents"), table(s, d, "blocks")),
    "p2_found": lambda s, d: conversations.found(s, f"{d}/history_messages.parquet"),
    "p2_conversations": lambda s, d: conversations.conversations(s, f"{d}/history_messages.parquet"),
    "p3_found": lambda s, d: near_duplicates.found(s, near_duplicates.image_records(table(s, d, "blocks"), table(s, d, "image_descriptions"))),
    "p3_groups": lambda s, d: near_duplicates.groups(s, near_duplicates.image_records(table(s, d, "blocks"), table(s, d, "image_descriptions"))),
    "p3_members": lambda s, d: near_duplicates.classes(s, near_duplicates.image_records(table(s, d, "blocks"), table(s, d, "image_descriptions")))[0],
    "p3_links": lambda s, d: near_duplicates.classes(s, near_duplicates.image_records(table(s, d, "blocks"), table(s, d, "image_descriptions")))[1],
    "p4_found": lambda s, d: personal.found(s, table(s, d, "memories"), table(s, d, "conversation_messages")),
    "p4_redacted": lambda s, d: personal.find(s, personal.values_of(table(s, d, "memories"), table(s, d, "conversation_messages"))),
    "p5_found": lambda s, d: lookalikes.found(s, table(s, d, "blocks"), table(s, d, "memories")),
    "p5_canonical": lambda s, d: lookalikes.canonical(s, lookalikes.values_of(table(s, d, "blocks"), table(s, d, "memories"))),
    "p7_found": lambda s, d: leakage.found(s, table(s, d, "documents"), table(s, d, "eval_questions")),
    "p7_leaks": lambda s, d: leakage.leaks(s, table(s, d, "documents"), table(s, d, "eval_questions")),
    "p6_pack": lambda s, d: packing.pack(s, table(s, d, "documents")),
    "p6_report": lambda s, d: packing.report(packing.pack(s, table(s, d, "documents"))),
    "p8_found": lambda s, d: reading_level.found(s, table(s, d, "documents"), table(s, d, "reading_labels")),
    "p8_levels": lambda s, d: reading_level.document_levels(s, table(s, d, "documents"), table(s, d, "reading_labels")),
    "p8_profile": lambda s, d: reading_level.profile(s, table(s, d, "documents"), table(s, d, "reading_labels")),
}

#: A word in DuckDB's dialect: a Chinese character, or letters and digits that are none.
WORD_SQL = r"[一-鿿㐀-䶿]|(?:[^\P{L}一-鿿㐀-䶿]|\p{N})+"
LOOKS_SQL = "".join(sorted(lookalikes.LOOKS))
PART_SQL = r"[\p{Latin}\p{N}_\p{Greek}\p{Cyrillic}]*"

#: The rows of problem 3 as sets of runs, their classes of equal sets, and the links between classes.
SETS = f"""t AS (SELECT DISTINCT 'blocks' AS tbl, block_id AS id, text FROM blocks WHERE block_id IS NOT NULL AND text IS NOT NULL
                   UNION ALL SELECT DISTINCT 'image_descriptions', content_hash, description FROM image_descriptions WHERE content_hash IS NOT NULL AND description IS NOT NULL),
        r AS (SELECT tbl, id, row_number() OVER (ORDER BY tbl, id, text) AS k, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM t),
        s AS (SELECT DISTINCT tbl, id, k, hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS h FROM (SELECT *, unnest(generate_series(1, len(w) - 2)) AS i FROM r)),
        st AS (SELECT tbl, id, k, list_sort(list(h)) AS hs FROM s GROUP BY ALL),
        c AS (SELECT tbl, hs, min(id) AS class_id, count(DISTINCT id) AS size, len(hs) AS n, row_number() OVER () AS c FROM st GROUP BY tbl, hs),
        e AS (SELECT tbl, c, unnest(hs) AS h FROM c), o AS (SELECT a.c AS ca, b.c AS cb, count(*) AS o FROM e a JOIN e b ON a.tbl = b.tbl AND a.h = b.h AND a.c < b.c GROUP BY a.c, b.c),
        l AS (SELECT x.tbl, ca, cb, x.class_id AS ia, y.class_id AS ib, o / (x.n + y.n - o) AS similarity FROM o JOIN c x ON x.c = ca JOIN c y ON y.c = cb WHERE 2 * o >= x.n + y.n - o)"""

SQL: dict[str, str] = {
    "p3_links": f"WITH {SETS} SELECT tbl, least(ia, ib) AS class_a, greatest(ia, ib) AS class_b, round(similarity, 6) AS similarity FROM l",
    "p3_members": f"""WITH {SETS}, g AS (SELECT c, count(*) AS links FROM (SELECT ca AS c FROM l UNION ALL SELECT cb FROM l) GROUP BY c),
        m AS (SELECT DISTINCT st.tbl, id, class_id, size, coalesce(links, 0) AS links FROM st JOIN c ON st.tbl = c.tbl AND st.hs = c.hs LEFT JOIN g USING (c)),
        a AS (SELECT DISTINCT 'blocks' AS tbl, block_id AS id FROM blocks WHERE block_id IS NOT NULL UNION ALL SELECT DISTINCT 'image_descriptions', content_hash FROM image_descriptions WHERE content_hash IS NOT NULL)
        SELECT a.tbl, a.id, coalesce(class_id, a.id) AS class_id, coalesce(size, 1) AS size, coalesce(links, 0) AS links FROM a LEFT JOIN m ON a.tbl = m.tbl AND a.id = m.id""",
    "p2_conversations": r"""
        WITH m AS (SELECT conversation_id, message_id, min(sequence) AS seq, min(role) AS role, min(content) AS content, bool_or(sequence IS NULL) AS no_seq
                   FROM history_messages WHERE conversation_id IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, CASE WHEN lower(trim(role)) IN ('user', 'human', '用户') THEN 'u' WHEN lower(trim(role)) IN ('assistant', 'ai', '助手') THEN 'a' WHEN lower(trim(role)) IN ('system', 'tool') THEN 's' END AS who,
                     regexp_matches(coalesce(content, ''), '[\p{L}\p{N}\p{P}\p{S}]') AS seen FROM m),
        c AS (SELECT conversation_id, bool_or(no_seq) OR min(seq) <> 1 OR max(seq) <> count(*) OR count(DISTINCT seq) <> count(*) OR count(who) <> count(*) OR bool_or(who <> 's' AND NOT seen) AS broken,
                     coalesce(string_agg(CASE WHEN who <> 's' THEN who END, '' ORDER BY seq), '') AS turns FROM r GROUP BY conversation_id)
        SELECT conversation_id, seq AS sequence, CASE who WHEN 'u' THEN 'user' ELSE 'assistant' END AS speaker, message_id, content
        FROM r JOIN c USING (conversation_id) WHERE NOT broken AND regexp_full_match(turns, '(ua+)+') AND who IN ('u', 'a')""",
    "p3_found": f"""
        WITH t AS (SELECT DISTINCT 'blocks' AS tbl, block_id AS id, text FROM blocks WHERE block_id IS NOT NULL AND text IS NOT NULL
                   UNION ALL SELECT DISTINCT 'image_descriptions', content_hash, description FROM image_descriptions WHERE content_hash IS NOT NULL AND description IS NOT NULL),
        r AS (SELECT tbl, id, row_number() OVER (ORDER BY tbl, id, text) AS k, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM t),
        s AS (SELECT DISTINCT tbl, id, k, hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS h FROM (SELECT *, unnest(generate_series(1, len(w) - 2)) AS i FROM r)),
        n AS (SELECT k, any_value(tbl) AS tbl, any_value(id) AS id, count(*) AS n FROM s GROUP BY k),
        o AS (SELECT a.k AS ka, b.k AS kb, count(*) AS o FROM s a JOIN s b ON a.tbl = b.tbl AND a.h = b.h AND a.k < b.k GROUP BY a.k, b.k)
        SELECT DISTINCT x.tbl, least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b
        FROM o JOIN n x ON x.k = ka JOIN n y ON y.k = kb WHERE x.id <> y.id AND 2 * o >= x.n + y.n - o""",
    "p5_found": rf"""
        WITH v AS (SELECT 'blocks' AS tbl, block_id AS row_id, 'text' AS field, text AS value FROM blocks UNION ALL SELECT 'blocks', block_id, 'heading_path', heading_path FROM blocks UNION ALL SELECT 'memories', id, 'statement', statement FROM memories)
        SELECT DISTINCT tbl, row_id, field FROM v
        WHERE regexp_matches(value, '[\x{{FF10}}-\x{{FF19}}\x{{FF21}}-\x{{FF3A}}\x{{FF41}}-\x{{FF5A}}\x{{300}}-\x{{36F}}\x{{AD}}\x{{200B}}\x{{200C}}\x{{2060}}\x{{FEFF}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{1D400}}-\x{{1D7FF}}\x{{FB00}}-\x{{FB06}}\x{{2E80}}-\x{{2FDF}}]')
           OR regexp_matches(value, '(^|[^\x{{1F000}}-\x{{1FAFF}}\x{{FE0F}}])\x{{200D}}') OR regexp_matches(value, '\p{{Latin}}{PART_SQL}[{LOOKS_SQL}]|[{LOOKS_SQL}]{PART_SQL}\p{{Latin}}')""",
    "p7_found": f"""
        WITH p AS (SELECT id AS item_id, question AS t FROM eval_questions UNION SELECT id, unnest(evidence).snippet FROM eval_questions),
        pw AS (SELECT item_id, regexp_extract_all(lower(t), '{WORD_SQL}') AS w FROM p),
        pg AS (SELECT DISTINCT item_id, hash(w[i : i + 14]) AS h FROM (SELECT *, unnest(generate_series(1, len(w) - 14)) AS i FROM pw)),
        dw AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents),
        dg AS (SELECT doc_id, hash(w[i : i + 14]) AS h FROM (SELECT *, unnest(generate_series(1, len(w) - 14)) AS i FROM dw))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN pg USING (h)""",
    "p1_found": r"""
        SELECT DISTINCT block_id,
               CASE WHEN regexp_matches(text, '[^\n。！？.!?；;]{1000}[^\n。！？.!?；;]{1000}[^\n。！？.!?；;]') THEN 'forced' ELSE 'natural' END AS cut
        FROM blocks WHERE chunk_type IS DISTINCT FROM 'code' AND length(text) > 2000""",
    "p2_found": r"""
        WITH m AS (SELECT conversation_id, message_id, min(sequence) AS seq, min(role) AS role, min(content) AS content,
                          bool_or(sequence IS NULL) AS no_seq
                   FROM history_messages WHERE conversation_id IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, CASE WHEN lower(trim(role)) IN ('user', 'human', '用户') THEN 'u'
                             WHEN lower(trim(role)) IN ('assistant', 'ai', '助手') THEN 'a'
                             WHEN lower(trim(role)) IN ('system', 'tool') THEN 's' END AS who,
                     regexp_matches(coalesce(content, ''), '[\p{L}\p{N}\p{P}\p{S}]') AS seen FROM m),
        c AS (SELECT conversation_id,
                     bool_or(no_seq) OR min(seq) <> 1 OR max(seq) <> count(*) OR count(DISTINCT seq) <> count(*) OR count(who) <> count(*)
                     OR bool_or(who <> 's' AND NOT seen) AS broken,
                     coalesce(string_agg(CASE WHEN who <> 's' THEN who END, '' ORDER BY seq), '') AS turns
              FROM r GROUP BY conversation_id)
        SELECT conversation_id FROM c WHERE broken OR NOT regexp_full_match(turns, '(ua+)+')""",
}
