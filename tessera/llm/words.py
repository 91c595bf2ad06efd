"""Words as the problems define them: runs of letters or digits, lower-cased, each Chinese character by itself."""

from __future__ import annotations

import re

import numpy as np

#: Chinese characters: the unified ideographs with extension A and the compatibility block, and the higher planes.
HAN = "〇㐀-䶿一-鿿豈-﫿\U00020000-\U000323af"
IS_HAN = re.compile(f"[{HAN}]")
WORD, RUN = re.compile(f"[^\\W_{HAN}]+"), re.compile(f"[{HAN}]+|[^\\W_{HAN}]+")


def words(text: str | None) -> list[str]:
    """The words of ``text`` in order; none for null."""
    if not text:
        return []
    text = text.lower()
    if not IS_HAN.search(text):
        return WORD.findall(text)
    out: list[str] = []
    for run in RUN.findall(text):
        if IS_HAN.match(run):
            out.extend(run)
        else:
            out.append(run)
    return out


C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * C2
        x = (x ^ (x >> np.uint64(27))) * C3
        return x ^ (x >> np.uint64(31))


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of every code point: 0 separates, 1 is part of a word, 2 is a word of its own. Built once per process."""
    if not _kinds:
        own = np.fromiter((chr(c).isalnum() for c in range(0x110000)), np.uint8, 0x110000)
        ends = re.findall(r"(.)(?:-(.))?", HAN, re.S)
        for low, high in ends:
            own[ord(low) : ord(high or low) + 1] = 2
        _kinds.append(own)
    return _kinds[0]


def hashes_of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts one after another, and how many each text has; equal in every process. The
    characters of all texts are handled together: a word's hash is the mixed sum of its (character, place) hashes."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[codes]
    at = np.flatnonzero(kind)
    kind, codes = kind[at], codes[at]
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    begins = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (kind[1:] == 2) | (kind[:-1] == 2)))
    starts = np.flatnonzero(begins)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    with np.errstate(over="ignore"):
        hashes = mix(np.add.reduceat(mix((codes.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64)), starts) + C2)
    ends = np.cumsum([len(t) + 1 for t in low])
    return hashes, np.diff(np.searchsorted(at[starts], ends, "left"), prepend=0)


class WordHashes:
    """64-bit hashes of words, equal in every process, kept per worker in a table that is emptied when it gets large."""

    def __init__(self, most: int = 2_000_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        except KeyError:
            from xxhash import xxh64_intdigest

            for w in set(found):
                if w not in known:
                    known[w] = xxh64_intdigest(w)
            return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` successive words, in order; empty for shorter texts."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = mix(word_hashes[:n] + C1)
        for k in range(1, size):
            out = mix(out * C1 + word_hashes[k : k + n])
    return out
