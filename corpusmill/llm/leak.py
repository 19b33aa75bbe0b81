"""Evaluation texts inside training texts: item-sized windows of words, CGK random-walk
embedding (edit distance to Hamming distance), repeated bit-sampling LSH, exact verification."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize
from .sieve import BITS, Sieve, sieve_of

#: Words of a window, repetitions of the embedding, embedded positions each samples, edits (in words) a match may have.
WINDOW, REPEATS, SAMPLES, EDITS = 12, 4, 8, 2
#: Words of the shortest item: it and longer ones below ``WINDOW`` words have one window, the whole item, and an
#: edit for every ``WORDS_AN_EDIT`` words at most.
SHORTEST, WORDS_AN_EDIT = 5, 6
#: Bits of a document's position in a pair of positions.
PLACE = 31
_U = np.uint64
MARKS = [*range(0x0610, 0x061B), *range(0x064B, 0x0660), 0x0670, *range(0x06D6, 0x06DD), *range(0x06DF, 0x06E5), 0x06E7, 0x06E8, *range(0x06EA, 0x06EE), 0x0640]


@functools.cache
def _fold() -> dict[int, str]:
    """Vowel marks, stretching and invisible signs vanish; punctuation and symbols part words."""
    t = {}
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))
        if k == "Cf":
            t[c] = ""
        elif k[0] in "PSZ" or k == "Cc":
            t[c] = " "
    return t | dict.fromkeys(MARKS, "")


def words_of(text: str) -> list[str]:
    """The words of a text, leaving aside case, punctuation, Arabic vowel marks,
    stretching and the kind of white space."""
    return unicodedata.normalize("NFC", text).lower().translate(_fold()).split()


@functools.cache
def _walks(repeats: int, samples: int, window: int) -> list[tuple[int, np.ndarray]]:
    rng = np.random.default_rng(77_003)
    # steps are sampled uniformly from 2 n; the walk has passed a window of n symbols
    # after that many on average, and later steps only see the padding
    return [(int(rng.integers(1, 1 << 62)), np.sort(rng.choice(2 * window, min(samples, 2 * window), replace=False))) for _ in range(repeats)]


def cgk_keys(symbols: np.ndarray, first: np.ndarray, window: int = WINDOW, repeats: int = REPEATS, samples: int = SAMPLES) -> np.ndarray:
    """uint64 keys (windows, repeats) of the windows of ``symbols`` that begin at ``first``.

    Each repetition walks every window at once: a step emits the symbol at the pointer
    (0 past the end) and moves the pointer on by a random bit of (step, symbol); the
    emitted symbols at the sampled steps are the key. Equal windows have equal keys."""
    out = np.zeros((len(first), repeats), _U)
    padded = np.append(symbols, _U(0))
    for r, (seed, steps) in enumerate(_walks(repeats, samples, window)):
        at, key, wanted = np.zeros(len(first), np.int64), np.full(len(first), r + 1 + 1_000 * window, _U), set(steps.tolist())
        for j in range(int(steps[-1]) + 1):
            sym = padded[np.where(at < window, first + at, len(symbols))]
            if j in wanted:
                key = (key ^ sym) * _U(0x9E3779B97F4A7C15)
                key ^= key >> _U(32)
            bit = (sym ^ _U((seed + j * 0x5851F42D4C957F2D) % (1 << 64))) * _U(0xD6E8FEB86659FD93)
            at += (bit >> _U(63)).astype(np.int64)
        out[:, r] = key
    return out


def part_keys(symbols: np.ndarray, first: np.ndarray, window: int, edits: int, shifts: int) -> np.ndarray:
    """uint64 keys (windows, parts and shifts) of the ``edits + 1`` parts of each window, each
    at its own place and up to ``shifts`` words beside it, within the window.

    Of two windows of one length within ``edits`` edits, one part of the first stands whole
    in the second, at most ``edits // 2`` words from its place, as each insertion before it
    is made up for by a deletion after it, or the other way round."""
    bounds = [window * i // (edits + 1) for i in range(edits + 2)]
    out = []
    for j, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        for s in range(max(-shifts, -lo), min(shifts, window - hi) + 1):
            key = np.full(len(first), 1_000_003 + j + 1_000 * window, _U)
            for i in range(lo + s, hi + s):
                key = (key ^ symbols[first + i]) * _U(0x9E3779B97F4A7C15)
                key ^= key >> _U(32)
            out.append(key)
    return np.stack(out, 1)


def _windows(words_per_text: list[list[str]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, and of each window its beginning, text and word position."""
    flat = [w for ws in words_per_text for w in ws]
    sym = pd.util.hash_array(np.array(flat, dtype=object), categorize=True) | _U(1) if flat else np.zeros(0, _U)
    lens = np.fromiter(map(len, words_per_text), np.int64, len(words_per_text))
    begin = np.cumsum(lens) - lens
    n = np.maximum(lens - window + 1, 0)
    text = np.repeat(np.arange(len(lens)), n)
    pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return sym, begin[text] + pos, text, pos


def _edits(length: int, edits: int) -> int:
    """Edits that a window of ``length`` words may have."""
    return min(edits, length // WORDS_AN_EDIT)


def _keyer(lengths: list[int] | None, window: int, edits: int, repeats: int, samples: int, parts: bool, sieve: Sieve | None):
    """The windows of texts with their keys: of items (``lengths`` is None) those of their own size;
    of documents those of all ``lengths``, with the keys that the sieve lets through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                ids, words = pdf["id"].to_numpy()[lo : lo + 500], [words_of(t) for t in pdf["text"].iloc[lo : lo + 500]]
                own = np.array([min(len(w), window) for w in words])
                for n in sorted({int(x) for x in own if x >= SHORTEST}) if lengths is None else lengths:
                    mine = np.flatnonzero(own == n) if lengths is None else np.arange(len(words))
                    sym, first, text, pos = _windows([words[i] for i in mine], n)
                    if not len(first):
                        continue
                    k = _edits(n, edits)
                    keys = cgk_keys(sym, first, n, repeats, samples)
                    if parts and k:
                        keys = np.concatenate([keys, part_keys(sym, first, n, k, 0 if lengths is None else k // 2)], 1)
                    hit = np.ones(keys.shape, bool) if sieve is None else sieve.has(keys)
                    some = np.flatnonzero(hit.any(1))
                    if len(some):
                        yield pd.DataFrame({"id": ids[mine[text[some]]], "pos": pos[some].astype(np.int32), "length": np.int32(n), "keys": [keys[i][hit[i]].view(np.int64) for i in some]})

    return run


def window_edits(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Insertions, deletions and replacements between the rows of ``a`` and ``b`` (pairs, words),
    all pairs at once; what exceeds ``most`` is ``most + 1``."""
    n = a.shape[1]
    far = np.full(len(a), most + 1, np.int32)
    prev = {j: np.full(len(a), j, np.int32) for j in range(min(most, n) + 1)}
    for i in range(1, n + 1):
        cur: dict[int, np.ndarray] = {}
        for j in range(max(0, i - most), min(n, i + most) + 1):
            if j == 0:
                cur[j] = np.full(len(a), i, np.int32)
                continue
            best = prev.get(j - 1, far) + (a[:, i - 1] != b[:, j - 1])
            best = np.minimum(best, np.minimum(prev.get(j, far), cur.get(j - 1, far)) + 1)
            cur[j] = np.minimum(best, far)
        prev = cur
    return prev[n]


def _verifier(edits: int, at_once: int = 200_000):
    """The exact edit distance of all candidate windows of pairs of an item and a document, whole
    batches of pairs at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes: dict[str, int] = {}
            begins: dict[str, int] = {}
            flat: list[int] = []

            def begin(t: str) -> int:
                at = begins.get(t)  # noqa: B023
                if at is None:
                    at = begins[t] = len(flat)  # noqa: B023
                    flat.extend(codes.setdefault(w, len(codes)) for w in words_of(t))  # noqa: B023
                return at

            first_a, first_b = np.array([begin(t) for t in pdf["item"]], np.int64), np.array([begin(t) for t in pdf["doc"]], np.int64)
            word = np.array(flat, np.int32)
            pair = np.repeat(np.arange(len(pdf)), pdf["places"].map(len))
            if not len(pair):
                continue
            place = np.concatenate(pdf["places"].to_list())
            length, item_pos, doc_pos = pdf["length"].to_numpy()[pair], place >> PLACE, place & ((1 << PLACE) - 1)
            for n in np.unique(length):
                most, step, mine = _edits(int(n), edits), np.arange(n), np.flatnonzero(length == n)
                for lo in range(0, len(mine), at_once):
                    q = mine[lo : lo + at_once]
                    d = window_edits(word[(first_a[pair[q]] + item_pos[q])[:, None] + step], word[(first_b[pair[q]] + doc_pos[q])[:, None] + step], most)
                    q, d = q[d <= most], d[d <= most]
                    if len(q):
                        yield pd.DataFrame({"item_id": pdf["item_id"].to_numpy()[pair[q]], "doc_id": pdf["doc_id"].to_numpy()[pair[q]], "length": np.int32(n), "item_pos": item_pos[q].astype(np.int32), "doc_pos": doc_pos[q].astype(np.int32), "edits": d.astype(np.int32)})

    return run


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, edits: int = EDITS, repeats: int = REPEATS, samples: int = SAMPLES, parts: bool = True, bits: int = BITS) -> DataFrame:
    """``(item_id, doc_id, length, item_pos, doc_pos, edits)``: windows of ``items (item_id, text)`` and of
    ``documents (doc_id, text)`` within ``edits`` edits of words, by the exact edit distance.

    A window has ``window`` words or, of a shorter item, the item's own (``SHORTEST`` at least), and an
    edit for every ``WORDS_AN_EDIT`` words. Equal windows share every key of the embedding, so
    windows without edits are found at any number of repetitions; with ``parts`` the parts of the
    windows are keys too, of which one is left whole, so that all within ``edits`` edits are found.

    Documents' windows pass a sieve of the items' keys, which has ``2**bits`` bits however many
    keys there are; what passes is joined by the keys themselves, as numbers, and only for
    pairs of an item and a document with a common key are texts fetched and compared.
    Texts are used whole; null texts and texts of fewer words than a window have no
    window. Repeated rows of one id count once."""
    side = lambda df, k: df.select(df[k].alias("id"), df["text"].alias("text")).where("id is not null and text is not null")
    kind = dict(items.dtypes)["item_id"], dict(documents.dtypes)["doc_id"]
    schema = "id {}, pos int, length int, keys array<bigint>"
    texts = side(items, "item_id")
    it = materialize(texts.mapInPandas(_keyer(None, window, edits, repeats, samples, parts, None), schema.format(kind[0])).select("id", "pos", "length", F.explode("keys").alias("key")), "leak-items")
    lengths = sorted(r[0] for r in it.select("length").distinct().collect())  # at most as many as words in a window
    docs = side(documents, "doc_id")
    seen = docs.mapInPandas(_keyer(lengths, window, edits, repeats, samples, parts, sieve_of(it, "key", bits)), schema.format(kind[1])).select(F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), F.explode("keys").alias("key"))
    place = F.shiftleft(F.col("pos").cast("bigint"), PLACE) + F.col("doc_pos")
    cand = seen.join(it.withColumnRenamed("id", "item_id"), "key").groupBy("item_id", "doc_id", "length").agg(F.collect_set(place).alias("places"))
    both = cand.join(texts.select(F.col("id").alias("item_id"), F.col("text").alias("item")), "item_id").join(docs.select(F.col("id").alias("doc_id"), F.col("text").alias("doc")), "doc_id")
    return both.mapInPandas(_verifier(edits), f"item_id {kind[0]}, doc_id {kind[1]}, length int, item_pos int, doc_pos int, edits int").distinct()


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, doc_id)``: documents that hold 12 or more successive words of an item. They are
    the matches of whole windows without an edit, which need no keys of parts."""
    return leaks(documents, items, parts=False).where((F.col("edits") == 0) & (F.col("length") == WINDOW)).select("item_id", "doc_id").distinct()


def near(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, doc_id, edits)``: documents that hold a window of an item with up to two edits of
    words, or a short item, with the fewest edits over the windows."""
    return leaks(documents, items, repeats=16, samples=5).groupBy("item_id", "doc_id").agg(F.min("edits").alias("edits"))
