"""Error rates and similarity of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import tokens


@F.pandas_udf(T.IntegerType())
def word_edits(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Edits between two arrays of words of any length, a row of the matrix at a time; null with a null."""
    out = []
    for a, b in zip(ref, hyp, strict=True):
        if a is None or b is None:
            out.append(None)
            continue
        ids: dict[str, int] = {}
        x = np.array([ids.setdefault(w, len(ids)) for w in a], np.int64)
        row, steps = np.arange(len(x) + 1), np.arange(len(x) + 1)
        for j, w in enumerate(b, 1):
            new = np.append(j, np.minimum(row[1:] + 1, row[:-1] + (x != ids.get(w, -1))))
            row = np.minimum.accumulate(new - steps) + steps
        out.append(int(row[-1]))
    return pd.Series(out, dtype="Int32")


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * (1 - insertions and deletions / both lengths); 100 for two empty texts, null with a null."""
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        row = np.zeros(len(x) + 1, np.int64)
        cp = np.frombuffer(x.encode("utf-32-le"), np.uint32)
        for ch in y:
            new = np.append(0, np.maximum(row[1:], row[:-1] + (cp == ord(ch))))
            row = np.maximum.accumulate(new)
        n = len(x) + len(y)
        out.append(100.0 * 2 * row[-1] / n if n else 100.0)
    return pd.Series(out, dtype="float64")


def corpus_error_rate(pairs: DataFrame, ref: str, hyp: str, unit: str = "word") -> DataFrame:
    """``(n, edits, units, rate)`` of the pairs of texts: edits of words or characters over the
    reference's; pairs with a null count as nothing, no unit at all gives a null rate."""
    d = pairs.where(F.col(ref).isNotNull() & F.col(hyp).isNotNull())
    if unit == "word":
        d = d.select(F.size(tokens(ref)).alias("u"), word_edits(tokens(ref), tokens(hyp)).alias("e"))
    else:
        d = d.select(F.length(ref).alias("u"), F.levenshtein(ref, hyp).alias("e"))
    return d.agg(F.count("*").alias("n"), F.sum("e").cast("bigint").alias("edits"), F.sum("u").cast("bigint").alias("units")).withColumn("rate", F.round(F.col("edits") / F.nullif("units", F.lit(0)), 6))
