"""Same or near-same texts across splits: minwise-hash shingles, banded buckets,
cross-split candidates, exact Jaccard similarity and exact edit distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import drop_shuffles, materialize, norm_key, norm_split, strip_ws
from .sieve import BITS, Sieve, sieve_of

#: Characters per shingle, bands, and minwise hashes per band. A pair of Jaccard
#: similarity s shares a bucket with probability 1-(1-s^ROWS)^BANDS: 0.94 at 0.4, 0.999 at 0.5.
SHINGLE, BANDS, ROWS = 3, 112, 4
#: Characters per gram of a sketch, and its 64-bit words.
GRAM, SKETCH = 2, 8
_WORDS = [f"s{i}" for i in range(SKETCH)]
#: Keys a text that a pass over some bands shuffles at most, and keys that are few enough for one pass.
KEYS, FEW_KEYS = 10, 500_000
_U = np.uint64


def _hash_params(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_117)
    return rng.integers(1, 1 << 63, n, dtype=_U) | _U(1), rng.integers(0, 1 << 63, n, dtype=_U)


def shingle_hashes(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``q``-character shingles of all texts, one after another, and
    where each text's begin. A text shorter than ``q`` is padded by NULs."""
    padded = [t if len(t) >= q else t + "\0" * (q - len(t)) for t in texts]
    lens = np.fromiter(map(len, padded), np.int64, len(padded))
    cp = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    n = len(cp) - q + 1
    h = np.zeros(n, _U)
    for i in range(q):
        h = (h ^ cp[i : i + n]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    begin = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=begin[1:])
    ends = begin + lens - q + 1
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, np.minimum(ends, n), -1)
    keep = np.cumsum(inside[:n]) > 0
    counts = lens - q + 1
    at = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=at[1:])
    return h[keep], at


def band_keys(texts: list[str], q: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, first: int = 0, last: int | None = None) -> np.ndarray:
    """int64 array (texts, bands): each band's bucket of each text; ``first`` and ``last``
    take some of the bands."""
    last = bands if last is None else last
    out = np.empty((len(texts), last - first), np.int64)
    if not texts:
        return out
    h, at = shingle_hashes(texts, q)
    a, b = _hash_params(bands * rows)
    with np.errstate(over="ignore"):
        for j in range(first, last):
            key = np.full(len(texts), j + 1, _U)
            for r in range(rows):
                i = j * rows + r
                v = h * a[i] + b[i]
                key = (key ^ np.minimum.reduceat(v >> _U(20), at)) * _U(0xBF58476D1CE4E5B9)
                key ^= key >> _U(31)
            out[:, j - first] = key.view(np.int64)
    return out


def sketches(texts: list[str], q: int = GRAM, words: int = SKETCH) -> np.ndarray:
    """uint64 array (texts, words): which of ``64 * words`` hash values the ``q``-grams of a
    text take; the second, third, ... occurrence of one has values of its own. One edit takes at most ``q``
    bits away and adds as many, so where one of two sketches has more than ``q * k`` bits that the other
    lacks, the texts are more than ``k`` edits apart."""
    out = np.zeros((len(texts), words), _U)
    if texts:
        h, at = shingle_hashes(texts, q)
        which = np.repeat(np.arange(len(texts)), np.diff(np.append(at, len(h))))
        order = np.lexsort((h, which))
        h, which = h[order], which[order]
        begins = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (which[1:] != which[:-1])))
        nth = np.arange(len(h)) - np.repeat(begins, np.diff(np.append(begins, len(h))))
        with np.errstate(over="ignore"):
            h = (h ^ nth.astype(_U)) * _U(0x9E3779B97F4A7C15)
        bit = (h >> _U(32)) % _U(64 * words)
        np.bitwise_or.at(out, (which, (bit >> _U(6)).astype(np.int64)), _U(1) << (bit & _U(63)))
    return out


def _sketcher(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lo in range(0, len(pdf), 2000):
            part = pdf.iloc[lo : lo + 2000].reset_index(drop=True)
            texts = part["text"].tolist()
            s = sketches(texts).view(np.int64)
            yield part.assign(n=[len(t) for t in texts], **{c: s[:, i] for i, c in enumerate(_WORDS)})


def _bander(q: int, bands: int, rows: int, first: int, last: int, sieve: Sieve | None):
    """The columns but the text, and the buckets of each text in some of the bands that the sieve lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                keys = band_keys(part.column("text").to_pylist(), q, bands, rows, first, last)
                hit = np.ones(keys.shape, bool) if sieve is None else sieve.has(keys.view(_U))
                ends = np.append(0, np.cumsum(hit.sum(1))).astype(np.int32)
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[hit]))], [*kept, "buckets"])

    return run


def bands_a_pass(n_train: int, n_eval: int, bands: int) -> int:
    """How many bands are joined at once: as many as have at most ``KEYS`` keys a text, if a quarter of
    the train keys and what else the sieve can't hold back pass it."""
    most = max(FEW_KEYS, KEYS * (n_train + n_eval))
    b = bands
    while b > 1 and b * (n_eval + n_train * min(1.0, 1.25 - math.exp(-b * n_eval / (1 << BITS)))) > most:
        b -= 1
    return -(-bands // -(-bands // b))


def _grams(c: Column, q: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (q - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(q))))


def overlapping_texts(
    rows: DataFrame,
    max_edit_share: float | None = 0.2,
    min_jaccard: float = 0.2,
    train: tuple[str, ...] = ("train",),
    evaluation: tuple[str, ...] = ("validation", "test"),
    q: int = SHINGLE,
    bands: int = BANDS,
    band_rows: int = ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of the train side that equal or nearly equal texts of the evaluation side.

    ``rows``: ``(id, split, text)``. Returns ``(members, pairs)``: ``members`` is
    ``(id, split, text, text_id)`` of all rows of either side, written to the
    shared folder; ``pairs`` is ``(train_text, eval_text, tt, et, jaccard, edits)``, the
    ``text_id`` and the text of both, each confirmed by the exact edit distance in code points or, if
    ``max_edit_share`` is None, by the exact Jaccard similarity of the shingle sets
    (``min_jaccard``). Edits can leave repetitive texts less than 0.2 of it, and a
    bucket seldom holds such a pair.

    Copies are collapsed before hashing, so a text that holds a third of all rows
    is one entry; buckets join train with evaluation entries only, and AQE splits
    a hot bucket. The bands are joined in passes, each of which leaves nothing but the pairs it
    was the first to confirm on the disk, so at most some ``KEYS`` keys a text are there at once, of any number of texts.
    Train buckets pass a sieve of the pass's evaluation buckets first, of a fixed size,
    which drops most that have no partner while the evaluation side is small. Lengths and
    sketches, which go with the keys, rule most candidates out without loss inside the join, before
    any is shuffled or any text is fetched. Texts are
    told apart by themselves, not by their numbers. Rows with a null id, split or text are
    left out; an empty table gives no pair; repeated rows count once; texts are used whole.
    """
    sides = rows.where(F.col("split").isin(*train, *evaluation) & F.col("id").isNotNull() & F.col("text").isNotNull())
    members = materialize(sides.select("id", "split", "text", F.xxhash64("text").alias("text_id")).distinct(), "crosssplit-members")
    texts = members.groupBy("text_id", "text").agg(F.max(F.col("split").isin(*train)).alias("in_train"), F.max(F.col("split").isin(*evaluation)).alias("in_eval"))
    texts = materialize(texts.mapInPandas(_sketcher, f"text_id bigint, text string, in_train boolean, in_eval boolean, n int, {', '.join(f'{c} bigint' for c in _WORDS)}"), "crosssplit-texts")
    step = bands_a_pass(*texts.agg(F.count_if("in_train"), F.count_if("in_eval")).first(), bands)

    def keys(side: str, p: str, first: int, sieve: Sieve | None) -> DataFrame:
        own = ["text_id", "n", *(_WORDS if max_edit_share is not None else [])]
        schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in own)
        d = texts.where(side).select(*own, "text").mapInArrow(_bander(q, bands, band_rows, first, min(first + step, bands), sieve), f"{schema}, buckets array<bigint>")
        return d.select(*[F.col(c).alias(p + c) for c in own], F.explode("buckets").alias("bucket"))

    t = texts.where("in_train").select(F.col("text_id").alias("train_text"), F.col("text").alias("tt"), F.col("n").alias("tn"))
    e = texts.where("in_eval").select(F.col("text_id").alias("eval_text"), F.col("text").alias("et"), F.col("n").alias("en"))

    def confirmed(first: int, before: list[DataFrame]) -> DataFrame:
        right = keys("in_eval", "e_", first, None)
        cand = keys("in_train", "t_", first, sieve_of(right, "bucket")).join(right, "bucket")  # a bucket's number holds its band
        if max_edit_share is not None:
            most = F.floor(F.greatest("t_n", "e_n") * max_edit_share)
            lacks = lambda a, b: sum((F.bit_count(F.col(a + c).bitwiseAND(F.bitwise_not(F.col(b + c)))) for c in _WORDS), F.lit(0)) <= GRAM * most
            cand = cand.where((F.abs(F.col("t_n") - F.col("e_n")) <= most) & ((F.least("t_n", "e_n") < GRAM) | lacks("t_", "e_") & lacks("e_", "t_")))
        cand = cand.select(F.col("t_text_id").alias("train_text"), F.col("e_text_id").alias("eval_text")).distinct()
        if before:
            cand = cand.join(reduce(DataFrame.unionByName, before).select("train_text", "eval_text"), ["train_text", "eval_text"], "left_anti")
        both = cand.join(t, "train_text").join(e, "eval_text")
        distance = F.levenshtein("tt", "et")
        if max_edit_share is not None:
            both = both.where(distance <= F.floor(F.greatest("tn", "en") * max_edit_share))
        return materialize(both.select("train_text", "eval_text", "tt", "et", distance.alias("edits")), "crosssplit-verified")

    passes: list[DataFrame] = []
    for first in range(0, bands, step):
        drop_shuffles(rows.sparkSession)
        passes.append(confirmed(first, passes))
    drop_shuffles(rows.sparkSession)
    both = reduce(DataFrame.unionByName, passes)
    both = both.withColumn("tg", _grams(F.col("tt"), q)).withColumn("eg", _grams(F.col("et"), q))
    common = F.size(F.array_intersect("tg", "eg"))
    both = both.withColumn("jaccard", common / (F.size("tg") + F.size("eg") - common))
    if max_edit_share is None:  # a confirmed edit distance stands at any similarity: repetitive texts have few shingles
        both = both.where(F.col("jaccard") >= min_jaccard)
    return members, both.select("train_text", "eval_text", "tt", "et", "jaccard", "edits")


def segments(df: DataFrame, min_words: int = 8) -> DataFrame:
    """``(id, split, text)`` of df_train_clean: ids and splits in one form, white
    space squeezed, texts of at least ``min_words`` words, one row per segment."""
    text = strip_ws(F.regexp_replace("transcript_nota", r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]+", " "))
    s = df.select(norm_key("audio_id").alias("id"), norm_split("split").alias("split"), text.alias("text"))
    return s.where(F.size(F.split("text", " ")) >= min_words)


def _side(members: DataFrame, splits: tuple[str, ...], text_id: str, text: str, key: str, *more: str) -> DataFrame:
    return members.where(F.col("split").isin(*splits)).select(F.col("text_id").alias(text_id), F.col("text").alias(text), F.col("id").alias(key), *more)


def found(df: DataFrame, train: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """``(audio_id_a, audio_id_b)``: the overlapping segment pairs, smaller id first."""
    members, pairs = overlapping_texts(segments(df), train=train, evaluation=evaluation)
    a, b = _side(members, train, "train_text", "tt", "ta"), _side(members, evaluation, "eval_text", "et", "eb")
    out = pairs.join(b, ["eval_text", "et"]).join(a, ["train_text", "tt"]).where(F.col("ta") != F.col("eb"))
    return out.select(F.least("ta", "eb").alias("audio_id_a"), F.greatest("ta", "eb").alias("audio_id_b")).distinct()


def by_split_and_source(df: DataFrame, train: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """``(split, source, n_pairs, n_segments)``: confirmed pairs and the evaluation
    segments in them, per evaluation split and source (null is a source of its own; of a segment
    delivered with several sources the smallest counts).
    Copies are not expanded: pairs of texts are weighed by their numbers of segments."""
    members, pairs = overlapping_texts(segments(df), train=train, evaluation=evaluation)
    source = df.select(norm_key("audio_id").alias("id"), "source").groupBy("id").agg(F.min("source").alias("source"))
    n_train = _side(members, train, "train_text", "tt", "id").groupBy("train_text", "tt").agg(F.countDistinct("id").alias("n"))
    per_eval = pairs.join(n_train, ["train_text", "tt"]).groupBy("eval_text", "et").agg(F.sum("n").alias("n"))
    ev = _side(members, evaluation, "eval_text", "et", "id", "split").join(source, "id")
    return ev.join(per_eval, ["eval_text", "et"]).groupBy("split", "source").agg(F.sum("n").alias("n_pairs"), F.countDistinct("id").alias("n_segments"))
