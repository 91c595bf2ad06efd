"""Problem 3: near-duplicate records, found by an exact similarity join on sets of word runs.

Method: token-combination prefixes. A record is its set of runs of SHINGLE successive words (tokens). Tokens have one global
order, rare ones first (by document frequency over all records, then hash). A record's prefix is its first tokens in that
order; tokens rarer than RARE are indexed one by one, the frequent ones are divided into classes and indexed by pairs from
one class, which are far rarer than either token. Combinations weaken a prefix: of each pair class one matching token may
stay without a partner, so the prefix is extended until its *gain* (rare tokens, and all but the first of each pair class)
exceeds the number of tokens that may be missing. Two records similar enough then share a signature:

    let x and y be similar, and x's prefix end first in the order; at most e(x) of x's tokens are not in y; so of a gain of
    e(x) + 1 at least one rare token, or two tokens of one class, are in y, and being early enough, in y's prefix.

For a smaller record e = n - ceil(overlap) with overlap >= 2n/3 at threshold 1/2 (the partner is no smaller), for a larger
one e = n - n/2. A signature is marked *inner* if it lies in the shorter prefix; the smaller record's must be.
Pair classes need enough tokens to pay for the extension, so records are handled in tiers by size: in the first, single
tokens only; in tier k, 16 * 8**k / 8 classes. Records less than twice a tier's upper size also take part in the tier
below, so every pair meets in the tier of its smaller record.

Candidates are bounded above without their sets (Hamming distance of parity bitmaps), and the rest is verified exactly.

Execution. Records are packed into batches (numpy arrays in binary columns), so that tokens move as a few bytes each:
  1 tokenise once; write batches and memberships to the shared folder; of the batches that hold a set, the first keeps it
  2 document frequency: distinct tokens per batch with counts, summed by hash range, answered as one byte per token
  3 signatures per batch, regrouped by hash range; candidates that pass the bitmap bound. The bitmaps lie in the shared folder
    once: a range, bounded in size, reads those of its records that meet another (sent along, a record's would be in every range)
  4 verify: the token sets of candidate records only (each batch is told which of its records are asked for)
Equal sets are one class: they collapse within each batch, then over all batches (16 bytes a set are shuffled), before anything
is counted, so a hot group of copies weighs as one record. Frequencies are summed before the shuffle, so a hot token costs
one entry per batch.
Within a signature only pairs that may count are enumerated: an inner record with the inner ones of its size and with the
records up to twice as large. A signature whose tokens are in more than HOT records is divided into blocks: an inner record
*owns* its pairs in one block and visits the others, so the work of a signature is spread over blocks of bounded size.

Defined results: null texts and texts under SHINGLE words have no tokens and no partners. Repeated rows of an id are one
record per distinct set; an id is never paired with itself. Every pair is written out, but for exact copies: of more than
EXPAND ids with one text, the smallest is paired with each of the others, and it alone is paired with the ids of other texts
(of an equal set or a similar one). Rows without an id are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import zstandard
from pyarrow.fs import FileSelector, FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.words import C1, hashes_of_texts, mix, shingle_hashes
from tessera.session import cut, scratch_path

SHINGLE, THRESHOLD = 3, 0.5
RARE = 6  # tokens in at most so many records are indexed singly
EXPAND = 32  # exact copies of one text that are paired in full
SPREAD = 16  # parts of a large class that are paired in different tasks
HOT = 8192  # records of a signature that are paired in one block
RANGE_TOKENS, LEAST_RANGES = 6_000_000, 6  # tokens of a hash range; ranges of a small table
MAP_TOKENS = 100_000_000  # tokens of the bitmaps in one file, some 55 MB
SIGNATURE_BITS = 29  # of a signature within its range
BATCH_DOCS, BATCH_TOKENS = 16384, 1_500_000
TOKEN_BITS = 44
TIERS = [(0, 34, 0)] + [(34 * 8**k, 34 * 8 ** (k + 1), 16 * 8**k) for k in range(5)]  # from, to (tokens), pair classes
TIERS[-1] = (TIERS[-1][0], 1 << 60, TIERS[-1][2])
PAIRS_AT_ONCE, CHARS_AT_ONCE = 1_000_000, 1_000_000


def squeeze(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, byte planes first (sorted and small numbers compress well that way)."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T if len(a) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def stretch(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.empty(0, dtype)


def squeeze_sorted(a: np.ndarray) -> bytes:
    """A sorted uint64 array as its differences."""
    d = np.diff(a, prepend=np.uint64(0))
    small = not len(d) or d.max() < 1 << 32
    return (b"4" if small else b"8") + squeeze(d.astype(np.uint32) if small else d)


def stretch_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(stretch(data[1:], np.uint32 if data[:1] == b"4" else np.uint64).astype(np.uint64), dtype=np.uint64)


def frequency_code(df: np.ndarray) -> np.ndarray:
    """One byte that orders frequencies: exact up to 32, then eight steps per doubling."""
    high = 32 + np.rint(8 * (np.log2(np.maximum(df, 32)) - 5))
    return np.where(df <= 32, df, np.minimum(high, 255)).astype(np.uint8)


def blocks_of_code(code: np.ndarray) -> np.ndarray:
    """The number of blocks of a signature whose rarest token has this frequency code."""
    df = np.where(code <= 32, code, np.exp2((code.astype(float) - 32) / 8 + 5))
    return np.maximum(1, np.ceil(df / HOT)).astype(np.int64)


def bitmaps(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The records' bitmaps in one array, with their offsets and widths in words. Bit i is the parity of the tokens that hash
    to it, so folding a bitmap in halves gives the smaller bitmap of the same set."""
    widths = bitmap_widths(sizes)
    offsets = np.cumsum(widths) - widths
    record = np.repeat(np.arange(len(sizes)), sizes)
    at = (mix(tokens + C1) >> np.uint64(20)).astype(np.int64) & (widths[record] * 64 - 1)
    bits = np.bincount(offsets[record] * 64 + at, minlength=int(widths.sum()) * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64), offsets, widths


def bitmap_widths(n: np.ndarray) -> np.ndarray:
    """64-bit words of the records' bitmaps: powers of two, 3 to 6 bits per token."""
    return np.left_shift(1, np.maximum(0, np.ceil(np.log2(np.maximum(3 * n.astype(np.int64), 1))).astype(np.int64) - 6))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, … of every span, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


# ---- 1 batches


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=BATCH_COLUMNS, dtype=object)


def _flush(task: int, number: int, held: list[tuple[int, np.ndarray]]) -> tuple:
    sizes = np.array([len(a) for _, a in held], np.int32)
    u, inverse = np.unique(np.concatenate([a for _, a in held]), return_inverse=True)
    return (None, None, None, None, (task << 20) + number, squeeze_sorted(u), squeeze_places(inverse), squeeze(sizes), squeeze(np.array([h for h, _ in held], np.uint64)), int(sizes.sum()))


def sets_of_frame(frame: pd.DataFrame, seeds: dict[str, np.uint64], shingle: int, at_once: int = CHARS_AT_ONCE) -> Iterator[tuple[str, str, int, int, np.ndarray]]:
    """(tbl, id, set hash, text hash, sorted tokens) of the rows that have tokens; the runs of ``at_once`` characters of text
    are found, hashed and sorted together."""
    tbls, ids, texts = frame["tbl"].to_numpy(), frame["id"].to_numpy(), frame["text"].tolist()
    for tbl in frame["tbl"].unique():
        if tbl not in seeds:
            seeds[tbl] = np.uint64(xxh64_intdigest(f"table {tbl}"))
    seed = np.array([seeds[t] for t in tbls], np.uint64)
    ends = np.cumsum([len(t) for t in texts])
    edges = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(at_once, int(ends[-1]) if len(ends) else 0, at_once)) + 1, [len(texts)])))
    for first, last in zip(edges.tolist(), edges.tolist()[1:], strict=False):
        hashes, sizes = hashes_of_texts(texts[first:last])
        if len(hashes) < shingle:
            continue
        row = np.repeat(np.arange(first, last), sizes)
        runs = shingle_hashes(hashes, shingle)
        within = row[: len(runs)] == row[shingle - 1 :]
        row, runs = row[: len(runs)][within], runs[within]
        if not len(runs):
            continue
        with np.errstate(over="ignore"):
            runs = mix(runs + seed[row]) >> np.uint64(64 - TOKEN_BITS)
            key = np.sort(((row - first).astype(np.uint64) << np.uint64(TOKEN_BITS)) | runs)
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            row, token = (key >> np.uint64(TOKEN_BITS)).astype(np.int64) + first, key & np.uint64((1 << TOKEN_BITS) - 1)
            starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            stops = np.append(starts[1:], len(row))
            # the table's seed is in the tokens, so equal texts of two tables are different sets
            h = mix(np.add.reduceat(mix(token), starts) + (stops - starts).astype(np.uint64) * C1)
        for r, k, s, e in zip(row[starts].tolist(), h.tolist(), starts.tolist(), stops.tolist(), strict=True):
            yield tbls[r], ids[r], k, xxh64_intdigest(texts[r]), token[s:e]


def signed(h: int) -> int:
    """An unsigned 64-bit hash as a long."""
    return h - (1 << 64) if h >> 63 else h


def squeeze_places(places: np.ndarray) -> bytes:
    """Places ascend within a record: their differences (modulo 2^32) are mostly small."""
    return squeeze(np.diff(places.astype(np.uint32), prepend=np.uint32(0)))


def stretch_places(data: bytes) -> np.ndarray:
    return np.cumsum(stretch(data, np.uint32), dtype=np.uint32)


BATCHES = "tbl string, id string, h long, x long, batch long, tokens binary, places binary, sizes binary, sets binary, total long"
BATCH_COLUMNS = [c.split()[0] for c in BATCHES.split(", ")]


def batches(records: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Memberships (tbl, id, h, x) and batches, as rows of one table; ``h`` is the hash of the set, ``x`` that of the text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        held: dict[int, np.ndarray] = {}
        total, seeds = 0, {}
        for frame in frames:
            members = []
            for tbl, key, h, x, own in sets_of_frame(frame, seeds, shingle):
                members.append((tbl, key, signed(h), signed(x), task << 20))  # in the bucket of the task's first batch: a file, not one for every bucket
                if h not in held:
                    held[h] = own
                    total += len(own)
                    if len(held) >= BATCH_DOCS or total >= BATCH_TOKENS:
                        yield _rows([_flush(task, number, list(held.items()))])
                        held, total, number = {}, 0, number + 1
            yield _rows([(*m, None, None, None, None, None) for m in members])
        if held:
            yield _rows([_flush(task, number, list(held.items()))])

    return records.where("id IS NOT NULL AND text IS NOT NULL").select("tbl", "id", "text").mapInPandas(run, BATCHES)


def repeated(spark: SparkSession, packed: DataFrame) -> DataFrame:
    """batch and gone: the sets of a batch that an earlier batch holds too. At most BATCH_DOCS of each batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for batch, sets in zip(frame["batch"], frame["sets"], strict=True):
                yield pd.DataFrame({"h": stretch(sets, np.uint64).view(np.int64), "batch": np.int64(batch)})

    held = packed.select("batch", "sets").mapInPandas(run, "h long, batch long")
    first = held.groupBy("h").agg(F.min("batch").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return cut(spark, held.join(first, "h").where("batch <> first").groupBy(F.col("batch").alias("b")).agg(F.collect_list("h").alias("gone")), "repeated")


def kept(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, places, sizes and sets of a batch's records without those that are gone, and the records' numbers."""
    u, places, sizes, sets = stretch_sorted(row.tokens), stretch_places(row.places), stretch(row.sizes, np.int32), stretch(row.sets, np.uint64)
    if row.gone is None or not len(row.gone):
        return u, places, sizes, sets, np.arange(len(sizes))
    stay = ~np.isin(sets, np.asarray(row.gone, np.int64).view(np.uint64))
    return u, places[np.repeat(stay, sizes)], sizes[stay], sets[stay], np.flatnonzero(stay)


# ---- 2 frequencies


def range_keys(spark: SparkSession, ranges: int) -> list[int]:
    """Group keys of the hash ranges that lie in different shuffle partitions, as far as there are enough."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own: dict[int, list[int]] = {}
    for k, p in spark.range(16 * max(ranges, parts)).select(F.col("id").cast("int"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))).collect():
        own.setdefault(p, []).append(k)
    turns = [k for n in range(max(map(len, own.values()))) for ks in own.values() for k in ks[n : n + 1]]
    return sorted(turns[:ranges])


def frequencies(packed: DataFrame, keys: list[int]) -> DataFrame:
    """batch and codes: for every batch, per hash range in order, one byte per distinct token. ``keys`` name the ranges."""
    ranges = len(keys)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                batch, (u, places, *_) = row.batch, kept(row)
                n = np.bincount(places, minlength=len(u)).astype(np.uint32)
                ends = np.searchsorted(u, (np.arange(1, ranges + 1, dtype=np.float64) * (2.0**TOKEN_BITS / ranges)).astype(np.uint64))
                starts = np.concatenate(([0], ends[:-1]))
                yield pd.DataFrame([(keys[r], batch, squeeze_sorted(u[s:e]), squeeze(n[s:e])) for r, (s, e) in enumerate(zip(starts, ends, strict=True)) if e > s], columns=["r", "batch", "tokens", "n"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("batch")
        own = [stretch_sorted(x) for x in frame["tokens"]]
        u, inverse = np.unique(np.concatenate(own), return_inverse=True)
        df = np.bincount(inverse, np.concatenate([stretch(x, np.uint32) for x in frame["n"]]), len(u))
        code = frequency_code(df)[inverse]
        ends = np.cumsum([len(x) for x in own])
        return pd.DataFrame([(b, int(frame["r"].iloc[0]), squeeze(code[e - len(x) : e])) for b, x, e in zip(frame["batch"], own, ends, strict=True)], columns=["b", "r", "codes"])

    asked = packed.select("batch", "tokens", "places", "sizes", "sets", "gone").mapInPandas(send, "r int, batch long, tokens binary, n binary")
    told = asked.groupBy("r").applyInPandas(answer, "b long, r int, codes binary")
    return told.groupBy("b").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "codes"))), lambda x: x["codes"]).alias("codes"))


# ---- 3 signatures


def signatures(u: np.ndarray, code: np.ndarray, places: np.ndarray, sizes: np.ndarray, rare: int = RARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, record, inner) of a batch (see ``coded_signatures``)."""
    return coded_signatures(u, code, places, sizes, rare)[:3]


def in_blocks(sig: np.ndarray, rec: np.ndarray, inner: np.ndarray, code: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, record, kind) with hot signatures divided into blocks: kind 0 owns its pairs, 1 is inner, 2 is neither."""
    kind = np.where(inner, 0, 2)
    count = blocks_of_code(code)
    hot = count > 1
    if not hot.any():
        return sig, rec, kind
    one = np.repeat(np.flatnonzero(hot), count[hot])
    block = spans(np.zeros(int(hot.sum()), np.int64), count[hot])
    owns = (sets[rec[one]] % count[one].astype(np.uint64)).astype(np.int64) == block
    more = np.where(inner[one], np.where(owns, 0, 1), 2)
    with np.errstate(over="ignore"):
        salted = mix(sig[one] + (block.astype(np.uint64) + np.uint64(1)) * C1)
    return np.concatenate([sig[~hot], salted]), np.concatenate([rec[~hot], rec[one]]), np.concatenate([kind[~hot], more])


def coded_signatures(u: np.ndarray, code: np.ndarray, places: np.ndarray, sizes: np.ndarray, rare: int = RARE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, record, inner, frequency code of its rarest token) of a batch: ``u`` its distinct tokens, ``code`` their
    frequencies, ``places`` the tokens of the records one after another, ``sizes`` how many each record has."""
    order = np.lexsort((u, code))
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    record = np.repeat(np.arange(len(sizes)), sizes)
    key = np.sort(record * len(u) + rank[places])
    at = order[key - record * len(u)]  # tokens of each record in the global order
    token, freq = u[at], code[at]
    starts = np.cumsum(sizes) - sizes
    out: list[tuple[np.ndarray, ...]] = []
    n_all = sizes.astype(np.int64)
    inner_need = n_all - -(-2 * n_all // 3) + 1
    outer_need = n_all - -(-n_all // 2) + 1
    for tier, (low, high, classes) in enumerate(TIERS):
        mine = (n_all >= low) & (n_all < 2 * high)
        if not mine.any():
            continue
        use = mine[record]
        rec, tok, fr = record[use], token[use], freq[use]
        first = np.concatenate(([True], rec[1:] != rec[:-1]))
        single = np.ones(len(rec), bool) if not classes else fr <= rare
        group = np.where(single, -1, (mix(tok) >> np.uint64(8)).astype(np.int64) % max(classes, 1))
        gain = single.copy()
        some = np.flatnonzero(~single)
        if len(some):  # all but the first of each record's pair class
            gk = rec[some] * classes + group[some]
            o = np.argsort(gk, kind="stable")
            later = np.concatenate(([False], gk[o][1:] == gk[o][:-1]))
            gain[some[o[later]]] = True
        total = np.cumsum(gain)
        base = (total - gain)[first]
        before = total - gain - np.repeat(base, np.diff(np.append(np.flatnonzero(first), len(rec))))
        outer = before < outer_need[rec]
        inner = before < inner_need[rec]
        salt = mix(np.array([tier + 1], np.uint64))[0]
        keep = np.flatnonzero(outer & single & (fr > 1))
        with np.errstate(over="ignore"):
            out.append((mix(tok[keep] + salt), rec[keep], inner[keep], fr[keep]))
            some = np.flatnonzero(outer & ~single & (fr > 1))
            if len(some):
                gk = rec[some] * classes + group[some]
                o = some[np.argsort(gk, kind="stable")]
                gk = np.sort(gk)
                lag = 1
                while True:
                    same = np.flatnonzero(gk[lag:] == gk[:-lag]) if lag < len(gk) else np.empty(0, int)
                    if not len(same):
                        break
                    a, b = o[same], o[same + lag]
                    out.append((mix(mix(tok[a] + salt) * C1 + tok[b]), rec[a], inner[b], np.minimum(fr[a], fr[b])))
                    lag += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.uint64), np.empty(0, int), np.empty(0, bool), np.empty(0, np.uint8))


def stored_bitmaps(spark: SparkSession, own: DataFrame, files: int) -> tuple[str, int]:
    """A folder of the shared folder with the bitmaps of the records that are kept (batch, docs, sizes, maps), and how many tokens
    these have. In few files, as every hash range reads all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                u, places, sizes, _, docs = kept(row)
                if len(docs):
                    yield pd.DataFrame([(row.batch, squeeze_places(docs), squeeze(sizes), bitmaps(u[places], sizes)[0].tobytes(), int(sizes.sum()))], columns=["batch", "docs", "sizes", "maps", "total"])

    path = scratch_path(spark, "maps")
    own.mapInPandas(run, "batch long, docs binary, sizes binary, maps binary, total long").repartition(files, "batch").write.parquet(path)
    return path, spark.read.parquet(path).agg(F.sum("total")).first()[0] or 0


def bitmaps_of(path: str, gid: np.ndarray, asked: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps (``width`` words each) of the ``asked`` among the ascending records ``gid``, and their offsets."""
    wide = np.where(asked, width, 0)
    offset = np.cumsum(wide) - wide
    out = np.zeros(int(wide.sum()), np.uint64)
    fs, folder = FileSystem.from_uri(path)
    for file in fs.get_file_info(FileSelector(folder)) if len(out) else []:
        if not file.base_name.endswith(".parquet"):
            continue
        with fs.open_input_file(file.path) as opened:
            for rows in pq.ParquetFile(opened, buffer_size=1 << 20).iter_batches(8, columns=["batch", "docs", "sizes", "maps"], use_threads=False):
                for batch, docs, sizes, maps in zip(*(c.to_pylist() if k < 3 else c for k, c in enumerate(rows.columns)), strict=True):
                    low, high = np.searchsorted(gid, (batch << 15, (batch + 1) << 15))
                    own = low + np.flatnonzero(asked[low:high])
                    if len(own):
                        widths = bitmap_widths(stretch(sizes, np.int32))
                        at = np.searchsorted(stretch_places(docs), (gid[own] & 0x7FFF).astype(np.uint32))
                        out[spans(offset[own], width[own])] = np.frombuffer(maps.as_buffer(), np.uint64)[spans((np.cumsum(widths) - widths)[at], width[own])]
    return out, offset


SENT = "r int, batch long, sig binary, rec binary, docs binary, sizes binary"


def send_signatures(joined: DataFrame, keys: list[int]) -> DataFrame:
    """Per batch and hash range: its signatures with the records they belong to, and those records' sizes.
    Within its range a signature keeps SIGNATURE_BITS: a range holds some million, and false meetings fail the bitmap bound."""
    ranges = len(keys)
    lows = np.array([r * (1 << 64) // ranges for r in range(ranges)], np.uint64)
    shift = np.uint64(max(0, ((1 << 64) // ranges).bit_length() - SIGNATURE_BITS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                u, places, sizes, sets, own = kept(row)
                if not len(own):
                    continue
                code = np.concatenate([stretch(x, np.uint8) for x in row.codes])
                sig, rec, kind = in_blocks(*coded_signatures(u, code, places, sizes), sets)
                order = np.argsort(sig)
                sig, rec, kind = sig[order], rec[order], kind[order]
                edges = np.append(np.searchsorted(sig, lows), len(sig))
                for r in range(ranges):
                    s, e = edges[r], edges[r + 1]
                    if s == e:
                        continue
                    docs, local = np.unique(rec[s:e], return_inverse=True)
                    yield pd.DataFrame([(keys[r], row.batch, squeeze_sorted((sig[s:e] - lows[r]) >> shift), squeeze((local * 4 + kind[s:e]).astype(np.uint32)), squeeze_places(own[docs]), squeeze(sizes[docs]))], columns=["r", "batch", "sig", "rec", "docs", "sizes"])

    return joined.mapInPandas(run, SENT)


def _fold(maps: np.ndarray, offset: np.ndarray, size: np.ndarray, to: int) -> np.ndarray:
    """The bitmaps at ``offset`` (of ``size`` words each, at least ``to``), folded to ``to`` words."""
    out = np.zeros((len(offset), to), np.uint64)
    for k in np.unique(size // to).tolist():
        rows = np.flatnonzero(size // to == k)
        for j in range(k):
            out[rows] ^= maps[(offset[rows] + j * to)[:, None] + np.arange(to)]
    return out


def passing(a: np.ndarray, b: np.ndarray, n: np.ndarray, maps: np.ndarray, offset: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Which candidate pairs may be similar: |x & y| <= (|x| + |y| - distance of their bitmaps) / 2."""
    ok = np.zeros(len(a), bool)
    small = np.minimum(width[a], width[b])
    for w in np.unique(small).tolist():
        own = np.flatnonzero(small == w)
        for part in np.array_split(own, max(1, len(own) * w // PAIRS_AT_ONCE)):
            x, y = a[part], b[part]
            distance = np.bitwise_count(_fold(maps, offset[x], width[x], w) ^ _fold(maps, offset[y], width[y], w)).sum(1, dtype=np.int64)
            both = n[x] + n[y]
            ok[part] = 3 * (both - distance) >= 2 * both  # overlap / union >= 1/2: overlap >= both / 3
    return ok


def candidates(sent: DataFrame, maps: str) -> DataFrame:
    """ga < gb (batch and place of the records): pairs that share a signature and pass the bounds. ``maps`` is the folder of the
    records' bitmaps."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("batch")
        sigs, recs, gids, sizes, base = [], [], [], [], 0
        for row in frame.itertuples():
            docs = stretch_places(row.docs)
            sigs.append(stretch_sorted(row.sig).astype(np.uint32))
            recs.append(stretch(row.rec, np.uint32) + np.uint32(4 * base))
            gids.append((np.int64(row.batch) << 15) + docs.astype(np.int64))
            sizes.append(stretch(row.sizes, np.int32))
            base += len(docs)
        del frame
        gid, n = np.concatenate(gids), np.concatenate(sizes)
        del gids, sizes
        sig = np.concatenate(sigs)
        del sigs
        order = np.arange(len(sig), dtype=np.uint64)  # signature and place in one number, sorted in its place
        order |= sig.astype(np.uint64) << np.uint64(32)
        order.sort()
        sig = (order >> np.uint64(32)).astype(np.uint32)
        same = sig[1:] == sig[:-1]
        met = np.concatenate((same, [False])) | np.concatenate(([False], same))  # others are alone with their signature
        rec = np.concatenate(recs)[(order & np.uint64(0xFFFFFFFF))[met].astype(np.uint32)]
        sig = sig[met]
        del recs, order, same, met
        n = n.astype(np.int32)
        width = bitmap_widths(n)
        rec, kind = (rec >> np.uint32(2)).astype(np.int32), (rec & np.uint32(3)).astype(np.uint8)
        key = (sig.astype(np.uint64) << np.uint64(32)) | (n[rec].astype(np.uint64) << np.uint64(2)) | kind  # by signature, size and kind
        del sig, kind
        o = np.argsort(key)
        key, rec = key[o], rec[o]
        del o
        own = np.flatnonzero((key & np.uint64(3)) == 0)
        high, size = key[own] >> np.uint64(32) << np.uint64(32), (key[own] & np.uint64(0xFFFFFFFF)) >> np.uint64(2)
        same = np.searchsorted(key, high | (size << np.uint64(2)) | np.uint64(2))  # the end of the inner records of its size
        larger = np.searchsorted(key, high | ((size + np.uint64(1)) << np.uint64(2)))
        end = np.searchsorted(key, high | (np.minimum(2 * size, np.uint64((1 << 30) - 1)) << np.uint64(2)) | np.uint64(3))
        left, first, length = np.concatenate([own, own]), np.concatenate([own + 1, larger]), np.concatenate([same - own - 1, end - larger])
        some = length > 0
        left, first, length = left[some], first[some], length[some]
        partner = np.cumsum(np.bincount(first, minlength=len(key) + 1) - np.bincount(first + length, minlength=len(key) + 1))[:-1] > 0
        asked = np.zeros(len(gid), bool)  # the records that meet another
        asked[rec[left]], asked[rec[partner]] = True, True
        m, offset = bitmaps_of(maps, gid, asked, width)
        out: list[np.ndarray] = []
        edges = np.concatenate(([0], np.cumsum(length)))
        at = 0
        while at < len(left):  # as many records at once as make PAIRS_AT_ONCE pairs; a single one is bounded by its block
            stop = max(at + 1, int(np.searchsorted(edges, edges[at] + PAIRS_AT_ONCE, "right")) - 1)
            x, y = rec[np.repeat(left[at:stop], length[at:stop])], rec[spans(first[at:stop], length[at:stop])]
            fits = x != y
            x, y = x[fits], y[fits]
            pair = np.unique(np.minimum(x, y).astype(np.int64) * len(gid) + np.maximum(x, y))
            x, y = pair // len(gid), pair % len(gid)
            good = passing(x, y, n, m, offset, width)
            out.append(pair[good])
            at = stop
        pair = np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)
        x, y = pair // max(1, len(gid)), pair % max(1, len(gid))
        return pd.DataFrame({"ga": np.minimum(gid[x], gid[y]), "gb": np.maximum(gid[x], gid[y])})

    return sent.groupBy("r").applyInPandas(run, "ga long, gb long").distinct()


# ---- 4 verification


def verified(spark: SparkSession, packed: DataFrame, pairs: DataFrame) -> DataFrame:
    """ha, hb and similarity of the candidate pairs that are similar enough."""
    asked = pairs.select(F.explode(F.array("ga", "gb")).alias("g")).groupBy(F.shiftright("g", 15).alias("b")).agg(F.collect_set("g").alias("asked"))  # at most BATCH_DOCS

    def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                u, places, sizes, sets = stretch_sorted(row.tokens), stretch_places(row.places), stretch(row.sizes, np.int32), stretch(row.sets, np.uint64).view(np.int64)
                ends = np.cumsum(sizes)
                own = [(int(g), int(g) & 0x7FFF) for g in row.asked]
                yield pd.DataFrame([(g, int(sets[d]), squeeze_sorted(u[np.sort(places[ends[d] - sizes[d] : ends[d]])])) for g, d in own], columns=["g", "h", "s"])

    sets = packed.select("batch", "tokens", "places", "sizes", "sets").join(asked, F.col("batch") == F.col("b")).mapInPandas(sets_of, "g long, h long, s binary")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known: dict[bytes, np.ndarray] = {}
            rows = []
            for ha, hb, a, b in zip(frame["ha"], frame["hb"], frame["sa"], frame["sb"], strict=True):
                x = known[a] if a in known else known.setdefault(a, stretch_sorted(a))
                y = known[b] if b in known else known.setdefault(b, stretch_sorted(b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= THRESHOLD * (len(x) + len(y) - both):
                    rows.append((min(ha, hb), max(ha, hb), both / (len(x) + len(y) - both)))
            yield pd.DataFrame(rows, columns=["ha", "hb", "similarity"])

    one = pairs.join(sets.withColumnsRenamed({"g": "ga", "h": "ha", "s": "sa"}), "ga")
    return one.join(sets.withColumnsRenamed({"g": "gb", "h": "hb", "s": "sb"}), "gb").select("ha", "hb", "sa", "sb").mapInPandas(compare, "ha long, hb long, similarity double")


# ---- the operator


def bucketed(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``: a later join on it moves the other side only."""
    path = scratch_path(spark, "bucketed")
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    return spark.table(name)


def similar_sets(spark: SparkSession, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): tbl, id, h, x of every record with tokens, and ha < hb, similarity of the linked classes."""
    stored = bucketed(spark, batches(records), "batch")
    packed = stored.where("total IS NOT NULL")
    members = stored.where("total IS NULL").select("tbl", "id", "h", "x").distinct()
    total = packed.agg(F.sum("total")).first()[0] or 0
    own = packed.select("batch", "tokens", "places", "sizes", "sets").join(repeated(spark, packed), F.col("batch") == F.col("b"), "left").drop("b")
    maps, total = stored_bitmaps(spark, own, max(1, -(-total // MAP_TOKENS)))
    keys = range_keys(spark, max(LEAST_RANGES, -(-total // RANGE_TOKENS)))
    joined = own.join(frequencies(own, keys), F.col("batch") == F.col("b")).drop("b")
    pairs = cut(spark, candidates(send_signatures(joined, keys), maps), "candidates")
    return members, verified(spark, packed, pairs)


def image_records(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """tbl, id, text of the two tables."""
    return blocks.select(F.lit("blocks").alias("tbl"), F.col("block_id").alias("id"), "text").unionByName(images.select(F.lit("image_descriptions").alias("tbl"), F.col("content_hash").alias("id"), F.col("description").alias("text")))


def found(spark: SparkSession, records: DataFrame) -> DataFrame:
    """p3_found: tbl, id_a, id_b (see the module's text for more than EXPAND exact copies)."""
    members, links = similar_sets(spark, records)
    members = cut(spark, members, "members")
    size = members.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    sized = members.join(size.where(F.col("size") > 1), "h")
    listed = sized.where(F.col("size") <= EXPAND).groupBy("h").agg(F.first("tbl").alias("tbl"), F.array_sort(F.collect_set("id")).alias("ids"))
    inside = listed.select("tbl", F.explode("ids").alias("id_a"), "ids").select("tbl", "id_a", F.explode("ids").alias("id_b"))
    # larger classes: copies of one text may be too many to pair, different texts are all paired
    large = sized.where(F.col("size") > EXPAND)
    copies = large.groupBy("h", "x").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"))
    placed = cut(spark, large.drop("size").join(copies, ["h", "x"]), "large")
    star = placed.where(F.col("copies") > EXPAND).select("tbl", F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    stand = placed.where((F.col("copies") <= EXPAND) | (F.col("id") == F.col("rep"))).select("tbl", "id", "h").distinct()
    left = stand.select("tbl", "h", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int").alias("part"))
    right = stand.select("h", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    apart = left.join(right, ["h", "part"]).where("id_a < id_b").select("tbl", "id_a", "id_b")
    # only classes that have a link are listed again
    ends = links.select(F.explode(F.array("ha", "hb")).alias("h")).distinct()
    shown = members.join(ends, "h", "left_semi").join(size.where(F.col("size") <= EXPAND), "h").select("tbl", "id", "h").unionByName(stand.join(ends, "h", "left_semi").select("tbl", "id", "h"))
    across = links.join(shown.select(F.col("h").alias("ha"), "tbl", F.col("id").alias("id_a")), "ha").join(shown.select(F.col("h").alias("hb"), F.col("id").alias("id_b")), "hb").select("tbl", "id_a", "id_b")
    pairs = inside.unionByName(star).unionByName(apart).unionByName(across).where("id_a <> id_b")
    return pairs.select("tbl", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def components(spark: SparkSession, links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """h and component (its smallest h) of every linked class, by label propagation with pointer jumping; each round is
    written to the shared folder. Raises if it has not settled after ``most_rounds`` (paths halve in length each round)."""
    edges = cut(spark, links.select("ha", "hb").unionByName(links.select(F.col("hb").alias("ha"), F.col("ha").alias("hb"))).distinct(), "edges")
    label = edges.groupBy("ha").agg(F.least(F.min("hb"), F.first("ha")).alias("c")).select(F.col("ha").alias("h"), "c")
    for _ in range(most_rounds):
        label = cut(spark, label, "labels")
        near = edges.join(label.withColumnRenamed("h", "hb"), "hb").groupBy("ha").agg(F.min("c").alias("m"))
        best = label.join(near, label["h"] == near["ha"]).select("h", "c", F.least("c", "m").alias("m"))
        jump = label.select(F.col("h").alias("p"), F.col("c").alias("pc"))
        new = cut(spark, best.join(jump, best["m"] == jump["p"], "left").select("h", F.col("c").alias("old"), F.least("m", F.coalesce("pc", "m")).alias("c")), "labels")
        if not new.where("old <> c").limit(1).count():
            return new.select("h", F.col("c").alias("component"))
        label = new.select("h", "c")
    raise RuntimeError("components did not settle")


def groups(spark: SparkSession, records: DataFrame) -> DataFrame:
    """tbl, id, group_id (smallest id of the group), links (similar classes, copies not counted), one row per record."""
    members, links = similar_sets(spark, records)
    links, members = cut(spark, links, "links"), cut(spark, members.drop("x").distinct(), "members")
    degree = links.select(F.explode(F.array("ha", "hb")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("links"))
    own = members.join(components(spark, links), "h", "left").join(degree, "h", "left").withColumn("component", F.coalesce("component", "h"))
    names = own.groupBy("tbl", "component").agg(F.min("id").alias("group_id"))
    # an id with several texts is in the group of the smallest name; records without tokens are groups of their own
    named = own.join(names, ["tbl", "component"]).groupBy("tbl", "id").agg(F.min("group_id").alias("group_id"), F.sum("links").alias("links"))
    every = records.where("id IS NOT NULL").select("tbl", "id").distinct()
    return every.join(named, ["tbl", "id"], "left").select("tbl", "id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def classes(spark: SparkSession, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole result without pairs of copies. Members: tbl, id, class_id (the smallest id of the records with its set of
    runs), size of the class, links (similar classes); one row per record and class, for records without runs a class of their
    own. Links: tbl, class_a, class_b, similarity."""
    members, links = similar_sets(spark, records)
    links, members = cut(spark, links, "links"), cut(spark, members.drop("x").distinct(), "members")
    names = cut(spark, members.groupBy("h").agg(F.first("tbl").alias("t"), F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size")), "names")
    degree = links.select(F.explode(F.array("ha", "hb")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("links"))
    own = members.join(names.join(degree, "h", "left").drop("t"), "h").select("tbl", "id", "class_id", "size", F.coalesce("links", F.lit(0)).alias("links"))
    every = records.where("id IS NOT NULL").select("tbl", "id").distinct()
    listed = every.join(own, ["tbl", "id"], "left").select("tbl", "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("links", F.lit(0)).alias("links"))
    end = lambda side: names.select(F.col("h").alias(f"h{side}"), F.col("t").alias(f"t{side}"), F.col("class_id").alias(f"c{side}"))
    joined = links.join(end("a"), "ha").join(end("b"), "hb")
    return listed, joined.select(F.col("ta").alias("tbl"), F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b"), F.round("similarity", 6).alias("similarity"))
