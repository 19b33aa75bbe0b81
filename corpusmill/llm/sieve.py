"""Filters of a fixed size for mappers: which keys, or words, can be in a table of any size.

A sieve lets every member through, and others by chance; what passes is joined with the
table itself. So results never depend on the sieve, and nothing of the driver or of a task
grows with the table: a table that is too large only makes the sieve pass more."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a sieve: 2**25 are 4 MB. Slots of a table of limits: 2**19 of 4 bytes are 2 MB.
BITS, SLOTS = 25, 19
#: Distinct words that a worker remembers.
REMEMBERED = 500_000


class Sieve:
    """Membership of 64-bit keys by one bit of a fixed array."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Of uint64 keys, which may be members."""
        at = keys & np.uint64((1 << self.bits) - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def sieve_of(keys: DataFrame, column: str, bits: int = BITS) -> Sieve:
    """The sieve of a bigint column. Bits are joined by partial aggregates; the driver gets at
    most ``2**bits / 64`` numbers, however many keys there are."""
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return Sieve(words, bits)


def word_hash(word: str) -> int:
    """What ``word_key`` gives for the word, as an unsigned number."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)


def word_key(c: Column | str) -> Column:
    return F.xxhash64(c)


class WordSieve:
    """Membership of words, with the greatest limit of the members of a word's slot (1 where
    there are no limits, 0 for words that are surely no members). Answers are remembered; ``hits`` are
    the words of the last ``among``, and some before it, that may be members."""

    def __init__(self, limits: np.ndarray):
        self.limits, self.known, self.hits = limits, {}, set()

    def __reduce__(self):
        return WordSieve, (self.limits,)

    def limit(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = int(self.limits[word_hash(word) & (len(self.limits) - 1)])
            if len(self.known) < REMEMBERED:
                self.known[word] = n
        return n

    def among(self, words: list[str]) -> bool:
        """Whether any of the words may be a member."""
        if len(self.known) >= REMEMBERED:
            self.known, self.hits = {}, set()
        own = set(words)
        self.hits.update(w for w in own.difference(self.known) if self.limit(w))
        return not self.hits.isdisjoint(own)


def word_sieve(words: DataFrame, column: str, limit: str | None = None, slots: int = SLOTS) -> WordSieve:
    """The sieve of a string column; ``limit`` names a column of limits. The driver gets at most
    ``2**slots`` numbers."""
    at = word_key(column).bitwiseAND(F.lit((1 << slots) - 1))
    rows = words.groupBy(at.alias("s")).agg(F.max(F.least(F.col(limit).cast("bigint"), F.lit((1 << 31) - 1)) if limit else F.lit(1)).cast("int").alias("n")).toArrow()
    out = np.zeros(1 << slots, np.int32)
    out[rows["s"].to_numpy()] = rows["n"].to_numpy()
    return WordSieve(out)
