"""Words, shingles and hashes shared by the text operators, and bits of keys."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def words(text: str | None) -> list[str]:
    """Lower-case words of a text; null gives none."""
    return [w.lower() for w in WORD.findall(text)] if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a uint64 over the others."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words, remembered between texts (the cache is emptied when
    it has grown to ``limit`` words; results do not depend on it)."""

    def __init__(self, limit: int = 200_000):
        self.seen: dict[str, int] = {}
        self.limit = limit

    def __call__(self, tokens: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.limit:
            seen.clear()
        out = np.empty(len(tokens), np.uint64)
        for i, w in enumerate(tokens):
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w)
            out[i] = h
        return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words, in order (empty if too short)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = mix(acc * _M1 + hashes[j : j + n] + np.uint64(j + 1))
    return acc


class KeyBits:
    """A bit for each of many 8-byte keys, modulo a fixed number of bits: bounded whatever
    their number, so it may go to all workers. It tells what is surely no key; what
    passes has to be joined with the keys all the same."""

    def __init__(self, keys: DataFrame, column: str, log2: int = 24):
        self.mask = (1 << log2) - 1
        at = F.col(column).bitwiseAND(F.lit(self.mask))
        made = keys.select(at.alias("at")).groupBy(F.shiftright("at", 15).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits")).collect()  # 2 ** (log2 - 15) rows of 4 kB at most
        self.bits = np.zeros(((1 << log2) >> 15, 4096), np.uint8)
        for r in made:
            self.bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
        self.bits = self.bits.reshape(-1)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Whether each of these (int64) may be a key."""
        at = keys & self.mask
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
