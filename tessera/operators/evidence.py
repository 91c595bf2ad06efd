"""Evidence: structural views, selection under a budget, merging, conflicts, citations, support."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VIEW_MIN = 200
MAX_SELECTED, MAX_CHARS, WINDOW = 8, 16000, 50
#: Units of numeric claims (fixed values).
UNITS = "%|ms|毫秒|秒|s|分钟|min|小时|h|MB|GB|KB|TB|QPS|qps|万|亿|倍|次"
CLAIM = rf"(\d+(?:\.\d+)?)\s*({UNITS})"
EDGE = re.compile(r"^(?:#{1,6}\s|\|.*\|\s*$|(?:```|~~~)|\s*(?:[-*+]|\d+[.)])\s)", re.M)


def segments(text: str, least: int = VIEW_MIN) -> list[tuple[int, int]]:
    """Spans that join to the text, cut before structural lines outside fences and at blank lines, none under ``least``."""
    cuts, at, fence = [0], 0, False
    kind = None
    for line in text.splitlines(keepends=True):
        plain = line.strip()
        mark = plain.startswith(("```", "~~~"))
        now = "fence" if fence or mark else "table" if plain.startswith("|") else "list" if re.match(r"(?:[-*+]|\d+[.)])\s", plain) else "heading" if plain.startswith("#") else "blank" if not plain else "text"
        if at and not fence and now != "blank" and (now != kind or now == "heading"):
            cuts.append(at)
        if mark:
            fence = not fence
        kind = now
        at += len(line)
    spans = list(zip(cuts, [*cuts[1:], len(text)], strict=True))
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and (out[-1][1] - out[-1][0] < least or e - s < least):
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def views(blocks: DataFrame) -> DataFrame:
    """block_id, view (0 the whole block), start, stop, view_id: the whole block, and its segments if there are two or more
    of VIEW_MIN characters each. Image descriptions stay whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text, kind in zip(frame["block_id"], frame["text"], frame["chunk_type"], strict=True):
                spans = segments(text) if kind != "image_description" else []
                spans = spans if len(spans) > 1 and all(e - s >= VIEW_MIN for s, e in spans) else []
                rows += [(key, n, s, e) for n, (s, e) in enumerate([(0, len(text)), *spans])]
            yield pd.DataFrame(rows, columns=["block_id", "view", "start", "stop"])

    once = blocks.where("block_id IS NOT NULL AND text IS NOT NULL AND text <> ''").groupBy("block_id").agg(F.min(F.struct("text", "chunk_type")).alias("r")).select("block_id", "r.*")
    out = once.mapInPandas(run, "block_id string, view int, start int, stop int")
    return out.withColumn("view_id", F.concat(F.lit("ev1-"), F.substring(F.sha2(F.concat_ws("\x1f", "block_id", F.col("start").cast("string"), F.col("stop").cast("string")), 256), 1, 32)))


def select_budget(scored: DataFrame, threshold: float, most: int = MAX_SELECTED, chars: int = MAX_CHARS, window: int = WINDOW) -> DataFrame:
    """query_id, view_id, selected, reason of every candidate (query_id, view_id, block_id, start, stop, score, rrf_rank).

    The window keeps the best ``window`` candidates by rrf_rank; of them those with a score of ``threshold`` or more
    survive; of views one of which contains the other one stays (the better score, then the larger); the rest is taken
    in order of score while it fits the quota and the characters, skipping what does not. Scores that are null, not finite
    or outside 0..1 fail the query's batch (reason invalid_score), nothing is passed on unfiltered.
    Selected and excluded rows together are all candidates.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rrf_rank", "view_id"], na_position="last")
        rows = [dict(zip(frame.columns, r, strict=True)) for r in frame.itertuples(index=False)]
        bad = any(r["score"] is None or not 0 <= r["score"] <= 1 for r in rows)
        out, left = [], []
        for n, r in enumerate(rows):
            why = "invalid_score" if bad else "outside_window" if n >= window else "below_threshold" if r["score"] < threshold else None
            (out.append((r["query_id"], r["view_id"], False, why)) if why else left.append(r))
        left.sort(key=lambda r: (-r["score"], r["start"] - r["stop"], r["rrf_rank"], r["view_id"]))
        kept: list[dict] = []
        used = 0
        for r in left:
            inside = any(k["block_id"] == r["block_id"] and (k["start"] <= r["start"] and r["stop"] <= k["stop"] or r["start"] <= k["start"] and k["stop"] <= r["stop"]) for k in kept)
            size = r["stop"] - r["start"]
            why = "contained" if inside else "over_quota" if len(kept) >= most else "over_budget" if used + size > chars else None
            out.append((r["query_id"], r["view_id"], why is None, why or "selected"))
            if why is None:
                kept.append(r)
                used += size
        return pd.DataFrame(out, columns=["query_id", "view_id", "selected", "reason"])

    return scored.groupBy("query_id").applyInPandas(run, "query_id string, view_id string, selected boolean, reason string")


def numeric_conflicts(evidence: DataFrame) -> DataFrame:
    """template, unit, numbers, sources: the same statement with different numbers in different sources (columns source, text).
    Statements are taken apart in the JVM; only distinct (template, unit, value, source) rows are shuffled."""
    s = evidence.select("source", F.explode(F.split("text", "[。！？\n]")).alias("s"))
    claims = F.regexp_extract_all("s", F.lit(CLAIM), 0)
    s = s.where(F.size(claims) == 1).select("source", F.trim(F.regexp_replace(F.regexp_replace("s", CLAIM, "{value}"), r"\s+", " ")).alias("template"), F.regexp_extract("s", CLAIM, 1).alias("value"), F.lower(F.regexp_extract("s", CLAIM, 2)).alias("unit"))
    s = s.where(F.regexp_replace("template", r"\{value\}", "").rlike("[a-zA-Z一-鿿]")).distinct()
    return s.groupBy("template", "unit").agg(F.countDistinct("value").alias("numbers"), F.countDistinct("source").alias("sources")).where("numbers >= 2 AND sources >= 2")


def merge(evidence: DataFrame) -> DataFrame:
    """evidence_id and sources of the exact-equal evidence (source_type, source_ref, content): one row per content of a reference."""
    h = F.sha2(F.coalesce("content", F.lit("")), 256)
    key = F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat_ws("\x1f", "source_type", "source_ref", h), 256), 1, 24))
    return evidence.groupBy(key.alias("evidence_id")).agg(F.count(F.lit(1)).alias("copies"), F.min("source_type").alias("source_type"), F.min("source_ref").alias("source_ref"))
