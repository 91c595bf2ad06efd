"""Problem 6: texts of varying length packed into containers of fixed token capacity.

Method: bounded-space online best-fit. Each packer keeps a fixed number of open bins; a bitset says which free spaces have
an open bin, so the best fit (the least free space that suffices) is the lowest set bit from the item's size up. When no
bin fits and all are open, the fullest closes first.

Sizes are counted with a public tokenizer's vocabulary file (``tokenizer`` is its path; never copied). An item over the
capacity is cut into full containers of its own and a rest that is packed like an item; no other item is split.

Distribution: every task packs its own rows as they come (no shuffle of texts: only keys and sizes go on). The bins that
are still open at the end of a task, at most ``OPEN`` each, are items of a second, equal round over groups of tasks, so
the space lost at the ends does not grow with the number of tasks. Round two moves only bin numbers and sizes.

Defined results: null and empty texts have no tokens and get container null. Repeated rows are packed once per row.
Container numbers are unique, not dense. With equal fit the bin opened first is taken.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut

CAPACITY, OPEN, GROUP = 2048, 64, 64
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The public splitting pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_encodings: dict[str, object] = {}


def token_counter(path: str):
    """A function from a text to its number of tokens; the vocabulary is loaded once per worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = _encodings[path].encode_ordinary
    return lambda text: len(encode(text))


class Packer:
    """Bounded-space best-fit over bins of one capacity."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most = capacity, most_open
        self.free: dict[int, deque[int]] = {}  # free space -> open bins, oldest first
        self.bits = 0
        self.open = 0
        self.bins = 0
        self.closed: list[tuple[int, int]] = []  # bin, tokens

    def _take(self, space: int) -> int:
        at = self.free[space].popleft()
        if not self.free[space]:
            del self.free[space]
            self.bits &= ~(1 << space)
        self.open -= 1
        return at

    def _put(self, at: int, space: int) -> None:
        if space == 0:
            self.closed.append((at, self.capacity))
            return
        self.free.setdefault(space, deque()).append(at)
        self.bits |= 1 << space
        self.open += 1

    def add(self, size: int) -> int:
        """The bin of an item of 1 to ``capacity`` tokens."""
        fitting = self.bits >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            at = self._take(space)
        else:
            if self.open >= self.most:
                least = (self.bits & -self.bits).bit_length() - 1
                self.closed.append((self._take(least), self.capacity - least))
            at, space = self.bins, self.capacity
            self.bins += 1
        self._put(at, space - size)
        return at

    def still_open(self) -> list[tuple[int, int]]:
        return sorted((at, self.capacity - space) for space, own in self.free.items() for at in own)


def _first_round(docs: DataFrame, capacity: int, most_open: int, tokenizer: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, packer, task = token_counter(tokenizer), Packer(capacity, most_open), TaskContext.get().partitionId() << 36
        for frame in frames:
            rows = []
            for key, text in zip(frame["k"], frame["t"], strict=True):
                size = count(text) if text else 0
                full, rest = divmod(size, capacity)
                if full and not rest:
                    full, rest = full - 1, capacity
                for n in range(full):
                    rows.append((key, n, capacity, task + packer.bins, None))
                    packer.bins += 1
                rows.append((key, full, rest, task + packer.add(rest) if rest else None, None))
            yield pd.DataFrame(rows, columns=["k", "part", "tokens", "bin", "fill"]).astype({"bin": "Int64", "fill": "Int64"})
        left = [(None, None, None, task + at, fill) for at, fill in packer.still_open()]
        yield pd.DataFrame(left, columns=["k", "part", "tokens", "bin", "fill"]).astype({"part": "Int32", "tokens": "Int64", "bin": "Int64", "fill": "Int64"})

    return docs.mapInPandas(run, f"k {docs.schema['k'].dataType.simpleString()}, part int, tokens long, bin long, fill long")


def _second_round(left: DataFrame, capacity: int, most_open: int) -> DataFrame:
    """bin and its final container: the open bins of up to GROUP tasks (at most GROUP * OPEN rows) packed together."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fill", "bin"], ascending=[False, True])
        packer, first, out = Packer(capacity, most_open * GROUP), {}, []
        for at, fill in zip(frame["bin"], frame["fill"], strict=True):
            to = packer.add(int(fill))
            out.append((at, first.setdefault(to, at)))
        return pd.DataFrame(out, columns=["b", "container"])

    return left.select(F.floor(F.shiftright(F.col("bin"), 36) / GROUP).alias("g"), "bin", "fill").groupBy("g").applyInPandas(run, "b long, container long")


def pack(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, most_open: int = OPEN, tokenizer: str = TOKENIZER) -> DataFrame:
    """``key``, part (from 0; more than one only where the text alone exceeds the capacity), first_token, tokens, container."""
    first = cut(spark, _first_round(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), capacity, most_open, tokenizer), "packing")
    moved = _second_round(first.where("fill IS NOT NULL").select("bin", "fill"), capacity, most_open)
    placed = first.where("fill IS NULL").join(moved, F.col("bin") == F.col("b"), "left")
    return placed.select(F.col("k").alias(key), "part", (F.col("part").cast("long") * capacity).alias("first_token"), "tokens", F.coalesce("container", "bin").alias("container"))


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, tokens and the share of the containers' space that is used."""
    per = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("fill"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"), F.round(F.sum("fill") / (F.count(F.lit(1)) * capacity), 4).alias("used"))
