"""Reports over manifests, segments and corpora: gates, rates, shares, summaries, warnings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..tables import norm_key, norm_split, rec_of
from .audit import no_nan
from .ranks import beside, exact_percentiles


def kept_by_length(df: DataFrame, text: str = "transcript_nota", min_len: int = 2) -> DataFrame:
    """``(split, n, n_kept)``: texts of at least ``min_len`` characters without outer white space."""
    return df.groupBy(norm_split("split").alias("split")).agg(F.count("*").alias("n"), F.count_if(F.length(tx.strip(text)) >= min_len).alias("n_kept"))


def phase_summary(df: DataFrame, text: str = "transcript_nota", min_len: int = 2) -> DataFrame:
    """``(split, n_in, n_kept, pct)`` of a phase that drops short texts."""
    d = kept_by_length(df, text, min_len).withColumnRenamed("n", "n_in")
    return d.withColumn("pct", F.round(100.0 * F.col("n_kept") / F.col("n_in"), 2))


def changed_rows(df: DataFrame, stages: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row: for each ``(before, after, name)`` the number of rows where they differ; two nulls are equal."""
    return df.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(n) for a, b, n in stages])


def rule_impact(df: DataFrame, layers: Sequence[str]) -> DataFrame:
    """One row: for each layer the number of rows whose flag ``<layer>_applied`` is true."""
    return df.agg(*[F.count_if(F.coalesce(F.col(f"{k}_applied"), F.lit(False))).alias(k) for k in layers])


def length_cap(df: DataFrame, key: str, text: str, share: float = 0.99, least: int = 5) -> DataFrame:
    """``(key, capped)``: the length of each text, at most the rounded percentile ``share`` of all
    lengths, which is ``least`` at least. Null texts are left out."""
    d = df.where(F.col(text).isNotNull()).select(key, F.length(text).cast("bigint").alias("_n"))
    row = exact_percentiles(d, {"n": F.col("_n")}, {"p": share}).first()
    cap = F.greatest(F.lit(least), F.round(F.lit(row["p"] if row else 0.0)).cast("bigint"))
    return d.select(key, F.least(F.col("_n"), cap).alias("capped"))


def speech_rate(words: Column, start: Column, end: Column) -> Column:
    """Words a second; segments of less than a second count as one second."""
    d = end - start
    return F.round(F.when(d < 1, words).otherwise(words / F.nullif(d, F.lit(0.0))), 4)


def code_switch_ratio(df: DataFrame, text: str) -> DataFrame:
    """``(segments, words)``: the shares of segments, and of words, with Latin letters."""
    w = tx.tokens(F.col(text))
    return df.where(F.col(text).isNotNull()).agg(F.round(F.avg(tx.has_latin(text).cast("double")), 6).alias("segments"), F.round(F.sum(F.size(F.filter(w, lambda y: y.rlike("[a-zA-Z]")))) / F.sum(F.size(w)), 6).alias("words"))


def code_switch_summary(df: DataFrame, before: str = "transcript_clean", after: str = "transcript_cs", splits: Sequence[str] = ("train", "test")) -> DataFrame:
    """``(metric, <split>, <split>_pct, ...)``: segments, those with Latin letters before, those
    changed and those with Latin letters after, side by side for the splits, with their shares."""
    s = norm_split("split")
    tests = {"total": F.lit(True), "with_latin": tx.has_latin(before), "changed": ~F.col(before).eqNullSafe(F.col(after)), "remaining": tx.has_latin(after)}
    one = df.agg(*[F.count_if(t & (s == k)).alias(f"{m}_{k}") for m, t in tests.items() for k in splits])

    def share(m: str, k: str) -> Column:
        return F.round(100.0 * F.col(f"{m}_{k}") / F.nullif(F.col(f"total_{k}"), F.lit(0)), 4)

    rows = [F.struct(F.lit(m).alias("metric"), *[x for k in splits for x in (F.col(f"{m}_{k}").alias(k), share(m, k).alias(f"{k}_pct"))]) for m in tests]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def sample_rates(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("sample_rate").agg(F.count("*").alias("n"))


def final_stats(manifest: DataFrame) -> DataFrame:
    """``(split, n_segments, total_hours, mean_s, median_s, min_s, max_s)`` of the kept rows."""
    d = manifest.where("kept").select(norm_split("split").alias("split"), no_nan("duration_s").alias("x"))
    base = d.groupBy("split").agg(F.count("*").alias("n_segments"), F.round(F.sum("x") / 3600, 4).alias("total_hours"), F.round(F.avg("x"), 3).alias("mean_s"), F.min("x").alias("min_s"), F.max("x").alias("max_s"))
    out = beside(base, exact_percentiles(d, {"x": F.col("x")}, {"p50": 0.5}, ["split"]), {"median_s": ("x", "p50")}, ["split"])
    return out.withColumn("median_s", F.round("median_s", 3))


def describe(df: DataFrame, x: Column) -> DataFrame:
    """Number, mean, deviation, least value, quartiles and greatest value; null and NaN are left out."""
    d = df.select(x.alias("x")).where("x is not null and not isnan(x)")
    base = d.agg(F.count("x").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("std"), F.min("x").alias("least"), F.max("x").alias("most"))
    shares = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    return beside(base, exact_percentiles(d, {"x": F.col("x")}, shares), {k: ("x", k) for k in shares})


def segments_per_recording(recordings: DataFrame) -> DataFrame:
    """``(least, most, mean, single)``; null segments count as none."""
    n = recordings.select(F.greatest(F.coalesce(F.size("segments"), F.lit(0)), F.lit(0)).alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"), F.count_if(F.col("n") == 1).alias("single"))


def mean_arabic_ratio(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.round(F.avg(tx.arabic_ratio(text)), 6).alias("ratio"))


def latency(timings: DataFrame, seconds: str, audio_s: str, begun: str, ended: str) -> DataFrame:
    """``(total, mean, median, wall, rtf)``: seconds that the requests took, and the real-time
    factor, which is the wall time from the first begin to the last end (epoch seconds) over the seconds of audio."""
    base = timings.agg(F.round(F.sum(seconds), 2).alias("total"), F.round(F.avg(seconds), 4).alias("mean"), (F.max(ended) - F.min(begun)).alias("wall"), F.sum(audio_s).alias("_audio"))
    base = base.withColumn("rtf", F.round(F.col("wall") / F.nullif("_audio", F.lit(0.0)), 4)).withColumn("wall", F.round("wall", 4)).drop("_audio")
    return beside(base, exact_percentiles(timings, {"x": F.col(seconds)}, {"p50": 0.5}), {"median": ("x", "p50")})


def corpus_hours(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.round(F.sum(no_nan("duration_s")) / 3600, 4).alias("hours"))


def split_share(manifest: DataFrame) -> DataFrame:
    """``(split, n, pct)`` of all rows."""
    total = manifest.agg(F.count("*")).scalar()
    return manifest.groupBy(norm_split("split").alias("split")).agg(F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / total, 4))


def distinct_recordings(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count_distinct(rec_of(norm_key("audio_id"))).alias("n"))


def count_tokens(df: DataFrame, text: str = "text", tokenizer: Callable[[Column], Column] = tx.tokens) -> DataFrame:
    """``(n)``: tokens of all texts by any function from a text to an array; null texts have none."""
    return df.agg(F.sum(F.when(F.col(text).isNotNull(), F.size(tokenizer(F.col(text))))).alias("n"))


def without_keyword(df: DataFrame, text: str, word: str) -> DataFrame:
    return df.where(~F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(word)))


def of_script(df: DataFrame, kind: str) -> DataFrame:
    """Rows whose ``type`` is ``kind``; an error without that column."""
    if "type" not in df.columns:
        raise ValueError("the texts have no column 'type'; classify them first")
    return df.where(F.col("type") == kind)


#: Columns that a finished dataset must have.
REQUIRED = ("audio_id", "audio", "text", "duration_s")


def dataset_warnings(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """``(split, warnings)``: one row per split label with the warnings of a finished dataset,
    none if all is well: columns that are missing, null and empty texts, null audio, durations of 0 or less."""
    fixed = [f"Missing required columns: {', '.join(sorted(set(required) - set(df.columns)))}"] if set(required) - set(df.columns) else []
    tests = []
    if "text" in df.columns:
        tests += [(F.col("text").isNull(), "null transcripts"), (tx.strip("text") == "", "empty transcripts")]
    if "audio" in df.columns:
        tests.append((F.col("audio").isNull(), "null audio entries"))
    if "duration_s" in df.columns:
        tests.append((F.col("duration_s") <= 0, "segments with duration <= 0"))
    d = df.groupBy("split").agg(F.count("*").alias("_n"), *[F.count_if(t).alias(f"_{i}") for i, (t, _) in enumerate(tests)])
    told = [F.when(F.col(f"_{i}") > 0, F.concat_ws(" ", F.col(f"_{i}").cast("string"), F.lit(what))) for i, (_, what) in enumerate(tests)]
    return d.select("split", F.array_compact(F.array(*[F.lit(x) for x in fixed], *told)).cast("array<string>").alias("warnings"))
