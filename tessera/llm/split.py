"""Problem 1: oversized items cut into pieces at natural boundaries.

Method: recursive bisection. A text over the limit is cut at the strongest boundary near its midpoint; halves still
over ``limit - overlap`` are cut again; then every piece but the first gets the ``overlap``
characters before it, and a few more where that would separate a character from its combining marks and there is room.

Defined results: null and empty texts, and texts within the limit, are one piece equal to the text (null stays null,
and its length counts as 0). Repeated rows of a block (same ``block_id``) are one block: the row with the smallest
``(document_order, imported_at, text)``, nulls last. Blocks without a ``document_order`` come after the others of
their document, by a hash of their id and the id. Blocks without ``block_id`` or ``doc_id`` are kept under that null
key. Extra columns are ignored; a clash of names with the result cannot occur as only named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
#: Marks that end a sentence, as the statement of the problem lists them.
ENDS = "。！？.!?；;"
END = re.compile("[\n" + re.escape(ENDS) + "]")

#: Boundaries by strength; a cut is made after the match.
BOUNDARIES = [
    (6, re.compile(r"\n[^\S\n]*\n+(?=#{1,6}\s)")),  # before a heading
    (5, re.compile(r"\n[^\S\n]*\n+")),  # between paragraphs
    (4, re.compile(r"\n")),
    (3, re.compile(r"[。！？；]+[”’」』）]*|[.!?;]+[\"')\]]*(?=\s)\s*")),
    (2, re.compile(r"[.!?;]+")),
    (1, re.compile(r"[，、：]|[,:]\s+|\s+")),
]
NATURAL = 2  # from this strength on a boundary is one of the statement's


def _attached(ch: str) -> bool:
    """Whether ``ch`` belongs to the character before it (combining marks, joiners, variation selectors)."""
    return unicodedata.combining(ch) != 0 or ch in "\u200d\ufe0e\ufe0f" or "\U0001f3fb" <= ch <= "\U0001f3ff"


def cut_near_middle(text: str, start: int, end: int, least: int) -> tuple[int, int]:
    """Position and strength of the strongest boundary near the midpoint of ``text[start:end]``.

    Looked for first in the middle half, then in all that leaves ``least`` characters on both sides; a weak boundary
    (below the statement's) is taken only if there is no natural one in either. Without any: the midpoint, moved off a
    combining sequence, with strength 0.
    """
    middle, quarter = (start + end) // 2, (end - start) // 4
    for floor in (NATURAL, 0):
        for low, high in ((middle - quarter, middle + quarter), (start + least, end - least)):
            for strength, pattern in BOUNDARIES:
                if strength < floor:
                    break
                best = min((m.end() for m in pattern.finditer(text, low, high) if low < m.end() < high), key=lambda p: (abs(p - middle), p), default=None)
                if best is not None:
                    return best, strength
    at = middle
    while at > start + least and (_attached(text[at]) or text[at - 1] == "\u200d"):
        at -= 1
    return at, 0


def bisect(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """The cores of the pieces as ``(start, end, strength of the cut before it)``; they join to the text."""
    if not 0 <= overlap <= limit // 3:
        raise ValueError("the overlap must be between 0 and a third of the limit")
    if len(text) <= limit:
        return [(0, len(text), 9)]
    done, todo = [], [(0, len(text), 9)]
    while todo:
        start, end, strength = todo.pop()
        if end - start <= limit - overlap:
            done.append((start, end, strength))
            continue
        at, found = cut_near_middle(text, start, end, max(overlap, 1))
        todo += [(at, end, found), (start, at, strength)]
    return done


def unbroken(text: str, at: int, most: int) -> int:
    """The length of the run without line feed and sentence mark that ``at`` lies in, counted up to ``most`` on either side."""
    ahead = END.search(text, at, at + most)
    low = max(0, at - most)
    behind = max((m.end() for m in END.finditer(text, low, at)), default=low)
    return (ahead.start() if ahead else min(len(text), at + most)) - behind


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """(start, stop, start of the core, strength of the cut before it, unbroken run at that cut) of every piece."""
    out = []
    for n, (start, stop, strength) in enumerate(bisect(text, limit, overlap)):
        at = max(0, start - overlap) if n else start
        while n and at > 0 and stop - at < limit and (_attached(text[at]) or text[at - 1] == "\u200d"):
            at -= 1
        out.append((at, stop, start, strength, unbroken(text, start, limit + 1) if strength < NATURAL else 0))
    return out


def kind_of(pieces: list[tuple[int, int, int, int, int]], limit: int = LIMIT) -> str:
    """``forced`` if a piece begins inside a run without line feed and sentence mark that is longer than the limit (such a run
    fits into no piece, so one does), else ``natural``."""
    return "forced" if any(run > limit for *_, run in pieces) else "natural"


def cut_kind(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """The kind of a text's cuts."""
    return kind_of(pieces_of(text, limit, overlap), limit)


def split_long(df: DataFrame, key: str = "block_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the rows whose text is over ``limit`` code points.

    One row per piece: ``key``, ``piece`` from 0, ``start`` and ``stop`` (code points, with the overlap), ``core_start``,
    ``strength`` of the cut before the piece (0 forced, 9 none), ``cut`` of the text as its pieces show it, ``piece_text``.
    Only the long texts leave the JVM; the filter is evaluated in the scan.
    """
    long = df.where(F.length(text) > limit).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame["k"], frame["t"], strict=True):
                own = pieces_of(t, limit, overlap)
                kind = kind_of(own, limit)
                rows += [(k, n, at, stop, start, strength, kind, t[at:stop]) for n, (at, stop, start, strength, _) in enumerate(own)]
            yield pd.DataFrame(rows, columns=["k", "piece", "start", "stop", "core_start", "strength", "cut", "piece_text"])

    out = long.mapInPandas(run, "k string, piece int, start int, stop int, core_start int, strength int, cut string, piece_text string")
    return out.withColumnRenamed("k", key)


def _kept():
    """What decides which row of a repeated block is kept: the smallest."""
    return F.struct(F.col("document_order").isNull().alias("no"), "document_order", F.col("imported_at").isNull().alias("ni"), "imported_at", "text", "doc_id", "chunk_type")


def one_row_per_block(blocks: DataFrame) -> DataFrame:
    """Each block once (see the module's text). Pre-aggregated before the shuffle, so copies of a hot block collapse early."""
    return blocks.groupBy("block_id").agg(F.min(_kept()).alias("r")).select("block_id", "r.doc_id", "r.document_order", "r.chunk_type", "r.text")


def renumber(counts: DataFrame, span: int = 1024, spread: int = 64) -> DataFrame:
    """``first_order`` of each block: how many pieces precede it in its document.

    ``counts`` has block_id, doc_id, document_order, pieces. A document may hold any share of all rows, so its running
    sum is taken in two levels: within spans of ``span`` successive orders (blocks without an order: ``spread`` hash
    spans after them), and over the sums of the spans.
    """
    h = F.when(F.col("document_order").isNull(), F.pmod(F.xxhash64("block_id"), F.lit(spread)).cast("int"))
    rows = counts.withColumns({"unordered": F.col("document_order").isNull(), "span": F.coalesce(h, F.floor(F.col("document_order") / span).cast("int"))})
    keys = ["doc_id", "unordered", "span"]
    sums = rows.groupBy(*keys).agg(F.sum("pieces").alias("in_span"))
    before = Window.partitionBy("doc_id").orderBy("unordered", "span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("in_span").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*keys).orderBy("document_order", "block_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("here", F.coalesce(F.sum("pieces").over(within), F.lit(0)))
    s = sums.select(*[F.col(k).alias(f"s_{k}") for k in keys], "offset")
    on = F.col("doc_id").eqNullSafe(F.col("s_doc_id")) & (F.col("unordered") == F.col("s_unordered")) & (F.col("span") == F.col("s_span"))
    return rows.join(s, on, "left").select("block_id", "doc_id", "document_order", "pieces", (F.col("here") + F.col("offset")).alias("first_order"))


def split_blocks(blocks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All blocks after the split: block_id, doc_id, piece, pieces, document_order (renumbered from 0), text.

    The numbering runs over ids and piece counts. The kept row of each block stays where its aggregate puts it, by block_id,
    and the numbers are brought there; long texts are split twice, for the counts and for the pieces, as moving the pieces
    would cost more.
    """
    once = one_row_per_block(blocks)
    counts = split_long(once, limit=limit, overlap=overlap).groupBy("block_id").agg(F.max(F.col("piece") + 1).alias("n"))
    slim = once.select("block_id", "doc_id", "document_order").join(counts, "block_id", "left").withColumn("pieces", F.coalesce("n", F.lit(1))).drop("n")
    order = renumber(slim).select("block_id", F.col("doc_id").alias("own"), "first_order")
    lone = once.where("block_id IS NULL").drop("document_order", "chunk_type")  # one row at most
    nameless = order.where("block_id IS NULL").drop("block_id")
    both = once.drop("document_order", "chunk_type").join(order, "block_id").unionByName(lone.join(nameless, lone["doc_id"].eqNullSafe(nameless["own"])))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for b, d, t, first in zip(frame["block_id"], frame["doc_id"], frame["text"], frame["first_order"], strict=True):
                own = [t[at:stop] for at, stop, *_ in pieces_of(t, limit, overlap)]
                rows += [(b, d, n, len(own), first + n, x) for n, x in enumerate(own)]
            yield pd.DataFrame(rows, columns=["block_id", "doc_id", "piece", "pieces", "document_order", "text"])

    long = F.coalesce(F.length("text") > limit, F.lit(False))
    whole = both.where(~long).select("block_id", "doc_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.col("first_order").cast("long").alias("document_order"), "text")
    return whole.unionByName(both.where(long).mapInPandas(run, "block_id string, doc_id string, piece int, pieces int, document_order long, text string"))


def chunk_counts(documents: DataFrame, blocks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and chunk_count of every document after the split; 0 where the document has no blocks."""
    once = one_row_per_block(blocks)
    extra = split_long(once, limit=limit, overlap=overlap).groupBy("block_id").agg((F.count(F.lit(1)) - 1).alias("extra"))
    per = once.select("block_id", F.col("doc_id").alias("h")).join(extra, "block_id", "left")
    per = per.groupBy("h").agg((F.count(F.lit(1)) + F.coalesce(F.sum("extra"), F.lit(0))).alias("n"))
    return documents.select("doc_id", "content_hash").join(per, F.col("content_hash") == F.col("h"), "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("chunk_count"))


def found(blocks: DataFrame) -> DataFrame:
    """p1_found: block_id and cut of the blocks over the limit that are not code, from the pieces of the operator."""
    return split_long(blocks.where(~F.col("chunk_type").eqNullSafe("code"))).where("piece = 0").select("block_id", "cut").distinct()
