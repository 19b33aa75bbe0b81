"""Exact percentiles of very large columns: a counted histogram over ordered buckets finds
the bucket of each wanted rank, a second pass orders only the values of those buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize

#: Buckets per power of two: a bucket spans at most 1/4096 of its values.
STEPS = 4096


def bucket_of(x: Column) -> Column:
    """An integer that never falls as ``x`` rises: exponent and first bits of the mantissa.
    A rounding error of the logarithm at a power of two moves a value, but not its order."""
    a = F.least(F.abs(x), F.lit(1.7e308))
    e = F.floor(F.log2(a))
    size = (e + 1100) * (2 * STEPS) + F.floor(a / F.pow(F.lit(2.0), e) * STEPS)
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("bigint")


def exact_percentiles(df: DataFrame, measures: dict[str, Column], shares: dict[str, float], by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``(*by, measure, n, *shares)``: of each measure and group the percentiles, interpolated
    between the two nearest values, as exact as a sort of the whole column.

    Null and NaN are left out; a group without values has no row. The first pass counts
    rows per bucket (with partial sums); the second pass reads the few buckets that hold a
    wanted rank, so no task holds or orders a column. Without ``by`` there are at most two
    buckets a measure and share, given to the scan as a filter; with groups they are written as a
    table, which Spark broadcasts or joins by its size."""
    by = list(by)
    own = F.array(*[F.struct(F.lit(k).alias("measure"), c.cast("double").alias("x")) for k, c in measures.items()])
    d = df.select(*by, F.explode(own).alias("_m")).select(*by, "_m.measure", (F.col("_m.x") + 0.0).alias("_x")).where("_x is not null and not isnan(_x)").withColumn("_b", bucket_of(F.col("_x")))
    keys = [*by, "measure"]
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counted = d.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    counted = counted.select(*keys, "_b", "_n", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("n"))
    at = [F.lit(p) * (F.col("n") - 1) for p in shares.values()]
    ranks = F.array_distinct(F.array(*[f(a).cast("bigint") for a in at for f in (F.floor, F.ceil)]))

    def inside(first: str, size: str) -> Column:
        return F.filter(ranks, lambda r: (r >= F.col(first)) & (r < F.col(first) + F.col(size)))

    wanted = counted.where(F.size(inside("_before", "_n")) > 0).select(*keys, "_b", "_before", "n")
    if by:
        w = materialize(wanted, "ranks-buckets").select(*[F.col(k).alias(f"_w_{k}") for k in keys], F.col("_b").alias("_wb"), "_before", "n")
        same = F.col("_b") == F.col("_wb")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_w_{k}"))
        some = d.join(w, same)
    else:
        rows = wanted.collect()  # at most two a measure and share
        some = d.where(F.lit(False)).withColumns({"_before": F.lit(0).cast("bigint"), "n": F.lit(0).cast("bigint")})
        if rows:
            here = F.lit(None)
            for r in rows:
                here = F.when((F.col("measure") == r["measure"]) & (F.col("_b") == r["_b"]), F.struct(F.lit(r["_before"]).alias("_before"), F.lit(r["n"]).alias("n"))).otherwise(here)
            some = d.where(F.col("_b").isin(*sorted({r["_b"] for r in rows}))).withColumn("_w", here).where("_w is not null").select(*keys, "_x", "_b", "_w.*")
    values = some.groupBy(*keys, "_b", "_before", "n", "_x").agg(F.count("*").alias("_k"))
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_k").over(in_bucket), F.lit(0)))
    found = values.select(*keys, "n", "_x", F.explode(inside("_first", "_k")).alias("_r"))
    out = []
    for name, p in shares.items():
        a = F.lit(p) * (F.col("n") - 1)
        low, high = F.max(F.when(F.col("_r") == F.floor(a), F.col("_x"))), F.max(F.when(F.col("_r") == F.ceil(a), F.col("_x")))
        part = F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
        out.append((low, high, part, name))
    g = found.groupBy(*keys, "n").agg(*[x.alias(f"_{k}_{name}") for low, high, _, name in out for k, x in (("l", low), ("h", high))])
    return g.select(*keys, "n", *[(F.col(f"_l_{name}") + F.when(part > 0, (F.col(f"_h_{name}") - F.col(f"_l_{name}")) * part).otherwise(0.0)).alias(name) for _, _, part, name in out])


def beside(stats: DataFrame, ranks: DataFrame, columns: dict[str, tuple[str, str]], by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``stats`` (one row a group of ``by``) with columns from ``exact_percentiles``: name to
    (measure, share); null for groups without values."""
    by = list(by)
    wide = ranks.groupBy(*by).agg(*[F.max(F.when(F.col("measure") == m, F.col(s))).alias(name) for name, (m, s) in columns.items()])
    right = wide.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *columns, F.lit(0).alias("_z"))
    same = F.col("_one") == F.col("_z")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return stats.withColumn("_one", F.lit(0)).join(right, same, "left").drop("_one", "_z", *[f"_k{i}" for i in range(len(by))])
