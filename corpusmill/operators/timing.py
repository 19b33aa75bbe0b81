"""Segment explosion, gaps between segments and gap smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import beside, exact_percentiles

ORDER = ("seg_start", "seg_end", "audio_id")


def explode_segments(recordings: DataFrame, key: str = "audio_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row ``(audio_id, rec_id, seg_idx, seg_start, seg_end, transcript, transcript_raw,
    *carry)`` per segment, in the order of the starts; missing bounds are 0.0, a missing raw
    text is the text; the columns ``carry`` of the recording are kept. Recordings with null or
    empty segments give no row (``skipped_recordings`` counts them)."""
    fixed = F.transform(
        "segments",
        lambda s: F.struct(F.coalesce(s["start"], F.lit(0.0)).alias("seg_start"), F.coalesce(s["end"], F.lit(0.0)).alias("seg_end"), s["transcript"].alias("transcript"), F.coalesce(s["transcript_raw"], s["transcript"]).alias("transcript_raw")),
    )
    d = recordings.select(F.col(key).alias("rec_id"), *carry, F.posexplode(F.array_sort(fixed)).alias("seg_idx", "s"))
    return d.select(F.concat_ws("_", "rec_id", F.col("seg_idx").cast("string")).alias("audio_id"), "rec_id", "seg_idx", "s.*", *carry)


def skipped_recordings(recordings: DataFrame) -> DataFrame:
    """``(n_recordings, n_skipped)``: all recordings and those without segments."""
    return recordings.agg(F.count("*").alias("n_recordings"), F.count_if(F.coalesce(F.size("segments"), F.lit(0)) <= 0).alias("n_skipped"))


def with_next_start(segments: DataFrame, rec: str = "rec_id", block_s: float = 3600.0) -> DataFrame:
    """``segments`` with ``next_start``, the start of the recording's next segment in the
    order (seg_start, seg_end, audio_id); null for its last. Rows without a start have none.

    A recording is ordered in blocks of ``block_s`` seconds; the last row of a block takes
    the first start of the recording's next block, of which there is one row per block. So
    no task orders a whole hot recording. Rows with equal keys keep any order."""
    b = F.floor(F.col("seg_start") / F.lit(block_s)).cast("bigint")
    d = segments.withColumn("_b", b)
    firsts = d.where("seg_start is not null").groupBy(rec, "_b").agg(F.min("seg_start").alias("_first"))
    ahead = firsts.select(rec, "_b", F.lead("_first").over(Window.partitionBy(rec).orderBy("_b")).alias("_ahead"))
    inside = F.lead("seg_start").over(Window.partitionBy(rec, "_b").orderBy(*ORDER))
    return d.withColumn("_in", inside).join(ahead, [rec, "_b"], "left").withColumn("next_start", F.when(F.col("seg_start").isNotNull(), F.coalesce("_in", "_ahead"))).drop("_b", "_in", "_ahead")


def gaps(segments: DataFrame, rec: str = "rec_id") -> DataFrame:
    """``segments`` with ``gap``: seconds up to the next segment's start, negative for overlaps."""
    return with_next_start(segments, rec).withColumn("gap", F.col("next_start") - F.col("seg_end"))


def smooth(segments: DataFrame, rec: str = "rec_id", small_gap: float = 0.2, large_gap: float = 1.0, max_extension: float = 0.3, fill_ratio: float = 0.5) -> DataFrame:
    """Ends moved towards the next start: snapped below ``small_gap``, extended by
    ``max_extension`` above ``large_gap``, by ``fill_ratio`` of the gap between; with
    ``seg_end_orig``, ``smoothing_applied`` and ``seg_duration``. The last segment of a
    recording and segments with null bounds stay."""
    e, g, n = F.col("seg_end"), F.col("gap"), F.col("next_start")
    new = F.when(g.isNull(), e).when(g < small_gap, n).when(g > large_gap, e + F.lit(max_extension)).otherwise(e + g * F.lit(fill_ratio))
    d = gaps(segments, rec).withColumn("_new", new).withColumn("seg_end_orig", e).withColumn("seg_end", F.col("_new"))
    d = d.withColumn("smoothing_applied", F.coalesce(F.col("seg_end") != F.col("seg_end_orig"), F.lit(False)))
    return d.withColumn("seg_duration", F.col("seg_end") - F.col("seg_start")).drop("_new", "next_start", "gap")


def smooth_array(segments: Column, small_gap: float = 0.2, large_gap: float = 1.0, max_extension: float = 0.3, fill_ratio: float = 0.5) -> Column:
    """The same rule within an array of segments, in the array's own order."""

    def one(s: Column, i: Column) -> Column:
        nxt = F.get(segments, i + 1)["start"]
        g = nxt - s["end"]
        return s.withField("end", F.when(g.isNull(), s["end"]).when(g < small_gap, nxt).when(g > large_gap, s["end"] + F.lit(max_extension)).otherwise(s["end"] + g * F.lit(fill_ratio)))

    return F.transform(segments, one)


def gap_stats(gapped: DataFrame, short: float = 0.2, long: float = 1.0, huge: float = 60.0) -> DataFrame:
    """One row of gap statistics; ``total_silence_s`` sums the positive gaps, ``net_s`` all."""
    g, d = F.col("gap"), gapped.where("gap is not null").select("gap")
    base = d.agg(
        F.count("*").alias("n_gaps"),
        F.round(F.avg(g), 3).alias("mean_gap"),
        F.round(100 * F.avg((g < short).cast("double")), 2).alias("pct_short"),
        F.round(100 * F.avg((g > long).cast("double")), 2).alias("pct_long"),
        F.round(F.max(g), 3).alias("max_gap"),
        F.count_if(g > huge).alias("n_huge"),
        F.round(F.sum(F.when(g > 0, g)), 2).alias("total_silence_s"),
        F.round(F.sum(g), 2).alias("net_s"),
    )
    return beside(base, exact_percentiles(d, {"g": g}, {"p50": 0.5}), {"median_gap": ("g", "p50")}).withColumn("median_gap", F.round("median_gap", 3))


def smoothing_summary(smoothed: DataFrame) -> DataFrame:
    """``(n, n_smoothed, pct_smoothed, hours_before, hours_after, hours_gained)``, over rows with both bounds."""
    d = smoothed.where("seg_start is not null and seg_end_orig is not null")
    before, after = F.sum(F.col("seg_end_orig") - F.col("seg_start")) / 3600, F.sum(F.col("seg_end") - F.col("seg_start")) / 3600
    n = F.count_if("smoothing_applied")
    return d.agg(
        F.count("*").alias("n"), n.alias("n_smoothed"), F.round(100 * n / F.count("*"), 2).alias("pct_smoothed"), F.round(before, 4).alias("hours_before"), F.round(after, 4).alias("hours_after"), F.round(after - before, 4).alias("hours_gained")
    )


def recording_durations(recordings: DataFrame, key: str = "audio_id") -> DataFrame:
    """``(rec_id, duration_s)``: the greatest segment end, 0.0 without segments."""
    return recordings.select(F.col(key).alias("rec_id"), F.coalesce(F.array_max(F.transform("segments", lambda s: s["end"])), F.lit(0.0)).alias("duration_s"))
