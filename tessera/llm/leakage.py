"""Problem 7: evaluation passages inside the corpus.

Method: spaced-seed hashing. Fixed masks say which of the next word positions enter a hash and which are ignored; the
hashes of all test passages are joined with those of every corpus position; around each hit the passage is laid along the
document on the hit's diagonal and compared word by word, substitutions allowed.

Every mask is shorter than ``MIN_RUN`` words, so a passage of that many equal words is hit whatever the masks ignore; an
ignored position may differ, so passages with single words replaced are hit too (their reach is reported, see
``overlaps``). The masks are fixed: no window is left out.

The test side is a stated query set. It is held in blocks of at most ``BLOCK_BYTES`` of text; each block is collected,
indexed and broadcast (its size is bounded by that parameter), and the corpus is read once per block. One block holds
some hundred thousand questions.

Defined results: null and empty texts have no words and no hits. For ``found``, passages under ``MIN_RUN`` words cannot
reach the required overlap and give nothing; for ``leaks`` a passage shorter than the required overlap counts if it stands
in the document as a whole (under the shortest mask it is hashed as a whole too). Items with null id are left out; repeated items and repeated documents count once. Of
equal overlaps the first passage counts. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import C1, WordHashes, mix, words

MIN_RUN = 15
BLOCK_BYTES = 32_000_000
#: Which of the following word positions enter the hash (1) and which are ignored (0).
MASKS = ("1110110010111", "110100110101111", "11110111")
MISMATCH = 3  # a replaced word costs as much as so many equal ones when the tolerant overlap is chosen
TAG, LINK, ENTITY = re.compile(r"</?[A-Za-z][^<>]{0,300}>"), re.compile(r"\]\([^()\s]*\)"), re.compile(r"&(?:[a-z]{2,8}|#\d{1,6});")


def plain_words(text: str | None) -> list[str]:
    """The words without those of markup (tags, link targets, entities)."""
    if text:
        if "<" in text:
            text = TAG.sub(" ", text)
        if "](" in text:
            text = LINK.sub("] ", text)
        if "&" in text:
            text = ENTITY.sub(" ", text)
    return words(text)


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash at each position that the mask fits into."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(len(mask) * 7919 + int(mask, 2)))
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1":
                out = (out ^ h[k : k + n]) * C1
                out ^= out >> np.uint64(29)
    return mix(out)


class PassageIndex:
    """The seed hashes of a block of test passages."""

    BITS = 22

    def __init__(self, passages: list[tuple[str, str]], min_run: int = MIN_RUN) -> None:
        hashes = WordHashes()
        self.items, self.words = [], []
        for item, text in passages:
            h = hashes(plain_words(text))
            if len(h) >= min_run:
                self.items.append(item)
                self.words.append(h)
        self.tables = []
        short = {len(h) for h in self.words if len(h) < min(map(len, MASKS))}
        for mask in (*MASKS, *("1" * n for n in sorted(short))):  # passages that no mask fits into have one of their own length
            own = [seed_hashes(h, mask) if mask in MASKS or len(h) == len(mask) else np.empty(0, np.uint64) for h in self.words]
            keys = np.concatenate(own) if own else np.empty(0, np.uint64)
            which = np.repeat(np.arange(len(own)), [len(x) for x in own])
            at = np.concatenate([np.arange(len(x)) for x in own]) if own else np.empty(0, int)
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << self.BITS, np.bool_)
            bits[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.tables.append((mask, keys[order], which[order], at[order], bits))

    def diagonals(self, h: np.ndarray) -> np.ndarray:
        """Distinct (passage, document position of the passage's first word) over all hits in ``h``."""
        pairs = []
        for mask, keys, which, at, bits in self.tables:
            own = seed_hashes(h, mask)
            if not len(own) or not len(keys):
                continue
            near = np.nonzero(bits[(own >> np.uint64(64 - self.BITS)).astype(np.int64)])[0]
            low, high = np.searchsorted(keys, own[near], "left"), np.searchsorted(keys, own[near], "right")
            n = high - low
            near, low, n = near[n > 0], low[n > 0], n[n > 0]
            if len(n):
                k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pairs.append(np.stack([which[k], np.repeat(near, n) - at[k]], 1))
        return np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), int)


def compare(h: np.ndarray, start: int, end: int, passage: np.ndarray, at: int) -> tuple[int, int, int]:
    """Along the diagonal inside ``h[start:end]``: the longest run of equal words, and of the best tolerant overlap
    (equal words count 1, replaced ones minus MISMATCH) its words and its replaced words."""
    low, high = max(start, at), min(end, at + len(passage))
    if high <= low:
        return 0, 0, 0
    same = h[low:high] == passage[low - at : high - at]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    runs = edges[1::2] - edges[::2]
    if not len(runs):
        return 0, 0, 0
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, -MISMATCH))))
    rise = score - np.minimum.accumulate(score)
    stop = int(rise.argmax())
    begin = int(np.flatnonzero(score[: stop + 1] == score[: stop + 1].min())[-1])
    return int(runs.max()), stop - begin, int((~same[begin:stop]).sum())


def passages_of(items: DataFrame) -> DataFrame:
    """item_id and passage: the question and every evidence snippet of the items."""
    snippets = F.transform(F.coalesce("evidence", F.array().cast("array<struct<doc:string,snippet:string>>")), lambda e: e["snippet"])
    return items.where("id IS NOT NULL").select(F.col("id").alias("item_id"), F.explode(F.concat(F.array("question"), snippets)).alias("passage")).where("passage IS NOT NULL").distinct()


def _scan(docs: DataFrame, index, key_type: str, least: int | None) -> DataFrame:
    """The best overlap of each document and item; with ``least`` the longest ones of each document and passage that has at
    least so many equal words, or all of its own, in the document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, table = WordHashes(), index.value
        for frame in frames:
            texts = [hashes(plain_words(t)) for t in frame["t"]]
            ends = np.cumsum([len(x) for x in texts])
            whole = np.concatenate(texts) if texts else np.empty(0, np.uint64)
            rows: dict[tuple[int, str | int], tuple[int, int, int]] = {}
            for p, at in table.diagonals(whole):
                passage = table.words[p]
                first = int(np.searchsorted(ends, max(at, 0), "right"))
                while first < len(ends) and (ends[first - 1] if first else 0) < at + len(passage):
                    got = compare(whole, int(ends[first - 1]) if first else 0, int(ends[first]), passage, int(at))
                    k = (first, table.items[p] if least is None else int(p))
                    if least is None:
                        if got[0] and got > rows.get(k, (0, 0, 0)):
                            rows[k] = got
                    elif got[1] - got[2] >= min(least, len(passage)):
                        rows[k] = tuple(map(max, got, rows.get(k, got)))
                    first += 1
            keys = frame["k"].tolist()
            yield pd.DataFrame([(keys[d], k if least is None else table.items[k], *v) for (d, k), v in rows.items()], columns=["doc_id", "item_id", "run", "words", "replaced"])

    return docs.mapInPandas(run, f"doc_id {key_type}, item_id string, run int, words int, replaced int")


def hits(spark: SparkSession, documents: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES, least: int | None = None) -> DataFrame:
    """The rows of ``_scan`` over all blocks of passages. Documents are read once per block; nothing is shuffled."""
    passages = passages_of(items)
    size = passages.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    docs = documents.select(F.col("doc_id").alias("k"), F.col("text").alias("t")).where("t IS NOT NULL AND t <> ''")
    out = None
    for n in range(blocks):
        own = passages.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == n).orderBy("item_id", "passage").collect()
        index = PassageIndex([tuple(r) for r in own], MIN_RUN if least is None else 1)
        found = _scan(docs, spark.sparkContext.broadcast(index), documents.schema["doc_id"].dataType.simpleString(), least)
        out = found if out is None else out.unionByName(found)
    return out


def overlaps(spark: SparkSession, documents: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, run (longest run of equal words), words and replaced (tolerant overlap), for every document and
    item with a hit. Nothing is shuffled but the hits."""
    return hits(spark, documents, items, block_bytes).groupBy("doc_id", "item_id").agg(F.max(F.struct("run", "words", "replaced")).alias("r")).select("doc_id", "item_id", "r.*")


def found(spark: SparkSession, documents: DataFrame, items: DataFrame) -> DataFrame:
    """p7_found: doc_id and item_id with a run of at least MIN_RUN equal words."""
    return overlaps(spark, documents, items).where(F.col("run") >= MIN_RUN).select("doc_id", "item_id").distinct()


def leaks(spark: SparkSession, documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """Every document with the items that leaked into it wholly or in part (``least`` equal words, or all of a shorter
    passage), words replaced in between allowed."""
    hit = hits(spark, documents, items, least=least)
    return hit.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("words").alias("longest"), F.max("run").alias("longest_run"))
