"""Percentiles of very large columns by mergeable q-digests: values quantised to a
bounded ordered universe, compressed dyadic-tree counts, merged by node addition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import exact_percentiles
from ..tables import materialize, norm_key, norm_split

#: Levels of the dyadic tree (2**BITS leaves) and the rank error as a share of the values.
BITS, EPS = 24, 0.005
#: Groups in which the tasks' digests are merged first.
FAN = 256
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def leaf_of(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The leaf of each double, in the order of the doubles: sign, exponent and the
    first bits of the mantissa. With 24 bits a leaf spans 1/4096 of its value at most."""
    u = (np.ascontiguousarray(x, np.float64) + 0.0).view(np.uint64)
    u = np.where(u >> np.uint64(63) == 1, ~u, u | np.uint64(1 << 63))
    return (u >> np.uint64(64 - bits)).astype(np.int64)


def value_of(leaf: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The double of a leaf that is next to zero."""
    shift = np.uint64(64 - bits)
    u = leaf.astype(np.uint64) << shift
    u = np.where(u >> np.uint64(63) == 1, u & np.uint64((1 << 63) - 1), ~(u | ((np.uint64(1) << shift) - np.uint64(1))))
    return u.view(np.float64)


def compress(nodes: np.ndarray, counts: np.ndarray, total: int, eps: float = EPS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The q-digest of tree nodes (root 1, children 2i and 2i+1, leaves from 2**bits):
    bottom up, a node, its sibling and their parent become the parent where they count
    at most ``total * eps / bits`` together."""
    limit = int(total * eps / bits)
    nodes, at = np.unique(nodes, return_inverse=True)
    counts = np.bincount(at, weights=counts, minlength=len(nodes)).astype(np.int64)
    if limit < 1:
        return nodes, counts
    for level in range(bits, 0, -1):
        low = np.searchsorted(nodes, 1 << level)
        high = np.searchsorted(nodes, 1 << (level + 1))
        if low == high:
            continue
        parents, where = np.unique(nodes[low:high] >> 1, return_inverse=True)
        pair = np.bincount(where, weights=counts[low:high], minlength=len(parents)).astype(np.int64)
        there = np.searchsorted(nodes[:low], parents)
        hit = (there < low) & (nodes[np.minimum(there, max(low - 1, 0))] == parents) if low else np.zeros(len(parents), bool)
        own = np.where(hit, counts[np.minimum(there, max(low - 1, 0))] if low else 0, 0)
        up = pair + own <= limit
        stay = ~up[where]
        gone = np.zeros(len(nodes), bool)
        gone[low:high] = ~stay
        gone[there[up & hit]] = True
        n = np.concatenate([nodes[~gone], parents[up]])
        c = np.concatenate([counts[~gone], (pair + own)[up]])
        order = np.argsort(n, kind="stable")
        nodes, counts = n[order], c[order]
    return nodes, counts


def _digester(eps: float, bits: int):
    def flush(parts: dict[tuple, list[np.ndarray]], digests: dict) -> None:
        for key, xs in parts.items():
            leaves, n = np.unique(leaf_of(np.concatenate(xs), bits) + (1 << bits), return_counts=True)
            old = digests.get(key, (np.zeros(0, np.int64), np.zeros(0, np.int64), 0))
            total = old[2] + int(n.sum())
            digests[key] = (*compress(np.concatenate([old[0], leaves]), np.concatenate([old[1], n]), total, eps, bits), total)
        parts.clear()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[tuple, list[np.ndarray]] = {}
        digests: dict[tuple, tuple] = {}
        held = 0
        for pdf in batches:
            for key, g in pdf.groupby(["measure", "grp"], dropna=False, sort=False):
                parts.setdefault(key, []).append(g["x"].to_numpy(np.float64))
            held += len(pdf)
            if held >= 1_000_000:
                flush(parts, digests)
                held = 0
        flush(parts, digests)
        for (measure, grp), (nodes, counts, _) in digests.items():
            yield pd.DataFrame({"measure": measure, "grp": None if grp is None or grp != grp else grp, "part": TaskContext.get().partitionId(), "node": nodes, "n": counts})

    return run


def _merger(eps: float, bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(np.int64)
        nodes, counts = compress(pdf["node"].to_numpy(np.int64), n, int(n.sum()), eps, bits)
        return pd.DataFrame({"measure": pdf["measure"].iloc[0], "grp": pdf["grp"].iloc[0], "part": pdf["part"].iloc[0], "node": nodes, "n": counts})

    return run


def _merged(parts: DataFrame, eps: float, bits: int) -> DataFrame:
    """Digests ``(measure, grp, part, node, n)`` with their nodes added and compressed, part by part."""
    return parts.groupBy("measure", "grp", "part").applyInPandas(_merger(eps, bits), "measure string, grp string, part bigint, node bigint, n bigint")


def digest(values: DataFrame, eps: float = EPS, bits: int = BITS) -> DataFrame:
    """``(measure, grp, node, n)``: the digests of ``values (measure, grp, x)``.

    Each task compresses its own part; the parts are merged and compressed again in ``FAN``
    groups of them, then these. A digest has some ``3 * bits / eps`` nodes a group at most, so
    no merge reads more than its share of parts times that, whatever the number of
    rows. Null and NaN are left out; -0.0 counts as 0.0; infinities are values."""
    clean = values.where("measure is not null and x is not null and not isnan(x)").select("measure", "grp", F.col("x").cast("double").alias("x"))
    parts = clean.mapInPandas(_digester(eps, bits), "measure string, grp string, part bigint, node bigint, n bigint")
    some = _merged(parts.withColumn("part", F.col("part") % FAN), eps, bits)
    return _merged(some.withColumn("part", F.lit(0).cast("bigint")), eps, bits).drop("part")


def merge(*digests: DataFrame, eps: float = EPS, bits: int = BITS) -> DataFrame:
    """Digests of separate portions or days joined: nodes are added, and compressed for the new
    total. A node below the root counts at most ``eps / bits`` of the values before and after, so the rank
    error stays within ``eps`` of all values, however often digests are merged."""
    all_ = digests[0]
    for d in digests[1:]:
        all_ = all_.unionByName(d)
    return _merged(all_.withColumn("part", F.lit(0).cast("bigint")), eps, bits).drop("part")


def _reader(percentiles: tuple[float, ...], eps: float, bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, n = pdf["node"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        level = np.floor(np.log2(node)).astype(np.int64)
        last = ((node + 1) << (bits - level)) - 1 - (1 << bits)
        order = np.lexsort((-level, last))
        upto = np.cumsum(n[order])
        total = int(upto[-1])
        at = [int(np.searchsorted(upto, max(1, int(np.ceil(p * total))))) for p in percentiles]
        v = value_of(last[order][at], bits)
        return pd.DataFrame({"measure": pdf["measure"].iloc[0], "grp": pdf["grp"].iloc[0], "percentile": percentiles, "value": v, "n": total, "max_rank_error": int(np.ceil(total * eps))})

    return run


def percentiles(digests: DataFrame, wanted: tuple[float, ...] = PERCENTILES, eps: float = EPS, bits: int = BITS) -> DataFrame:
    """``(measure, grp, percentile, value, n, max_rank_error)`` from merged digests.

    ``value`` is, but for its leaf's width, a value whose rank lies within
    ``max_rank_error`` = ceil(eps * n) of ceil(percentile * n). One group's nodes,
    at most 2**(bits+1) and in practice some thousands, meet in one task."""
    return digests.groupBy("measure", "grp").applyInPandas(_reader(wanted, eps, bits), "measure string, grp string, percentile double, value double, n bigint, max_rank_error bigint")


def manifest_values(manifest: DataFrame) -> DataFrame:
    """``(measure, grp, x)`` of ``duration_s`` and ``rms`` per split; one row per segment id
    (the greatest values, should deliveries differ). Rows without split form the group null."""
    one = manifest.select(norm_key("audio_id").alias("id"), norm_split("split").alias("grp"), F.struct(F.nanvl("duration_s", F.lit(None)).alias("d"), F.nanvl("rms", F.lit(None)).alias("r")).alias("v")).where("id is not null")
    one = one.groupBy("id").agg(F.max("grp").alias("grp"), F.max("v").alias("v"))
    return one.select("grp", F.explode(F.array(F.struct(F.lit("duration_s").alias("measure"), F.col("v.d").alias("x")), F.struct(F.lit("rms").alias("measure"), F.col("v.r").alias("x")))).alias("y")).select("y.measure", "grp", "y.x").where("x is not null")


def manifest_percentiles(manifest: DataFrame) -> DataFrame:
    """``(measure, split, percentile, value, n, max_rank_error)``."""
    return percentiles(digest(manifest_values(manifest))).withColumnRenamed("grp", "split")


def within_bound(manifest: DataFrame) -> DataFrame:
    """``(measure, split, n, median, within)``: the exact median, and whether every value of the
    digest keeps its stated error, by an exact count of the values below and above its leaf.
    The digest's few rows are a table, which Spark broadcasts or joins by its size."""
    v = materialize(manifest_values(manifest), "percentile-values")
    est = materialize(percentiles(digest(v)), "percentiles").select(F.col("measure").alias("_m"), F.col("grp").alias("_g"), "percentile", "value", F.col("n").alias("_n"), "max_rank_error")
    slack = F.abs("value") / F.lit(float(1 << (BITS - 12)))
    j = v.join(est, (F.col("measure") == F.col("_m")) & F.col("grp").eqNullSafe(F.col("_g")))
    counted = j.groupBy("measure", "grp", "percentile", "_n", "max_rank_error").agg(F.count("*").alias("n"), F.count_if(F.col("x") <= F.col("value") + slack).alias("le"), F.count_if(F.col("x") < F.col("value") - slack).alias("lt"))
    rank = F.ceil(F.col("percentile") * F.col("n"))
    ok = (F.col("le") + F.col("max_rank_error") >= rank) & (F.col("lt") - F.col("max_rank_error") <= rank) & (F.col("n") == F.col("_n"))
    kept = counted.groupBy("measure", "grp").agg(F.max("n").alias("n"), F.every(ok).alias("within"))
    exact = exact_percentiles(v.withColumnRenamed("measure", "_of"), {"x": F.col("x")}, {"median": 0.5}, ["_of", "grp"]).select("_of", F.col("grp").alias("_g"), "median")
    both = kept.join(exact, (F.col("measure") == F.col("_of")) & F.col("grp").eqNullSafe(F.col("_g")))
    return both.select("measure", F.col("grp").alias("split"), "n", F.round("median", 6).alias("median"), "within")


def leaf_percentiles(manifest: DataFrame) -> DataFrame:
    """``(measure, split, percentile, value, n)`` of a digest without error: with ``eps`` 0 nothing is
    compressed, and each value is the leaf of the exact one, its first 12 bits of mantissa."""
    return percentiles(digest(manifest_values(manifest), 0.0), eps=0.0).select("measure", F.col("grp").alias("split"), "percentile", F.round("value", 9).alias("value"), "n")
