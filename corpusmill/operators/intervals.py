"""Continuous periods and gaps of intervals per key (sweep line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import norm_key, rec_of

#: Width of a sweep block in milliseconds. Ticks are whole milliseconds, so a
#: block never holds more than this many rows, whatever the key's size.
BLOCK_MS = 600_000


def to_ms(seconds: Column) -> Column:
    """Seconds rounded to whole milliseconds; null for null, NaN and infinity."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 9e12)
    return F.when(ok, F.round(seconds * 1000).cast("bigint"))


def periods_and_gaps(intervals: DataFrame, key: str = "key", start: str = "start_ms", end: str = "end_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    """Rows ``(key, kind, start_ms, end_ms, n)`` of all periods and gaps.

    Method: each interval becomes a plus event at its start and a minus event at
    its end; events are summed per (key, millisecond); a prefix sum gives the
    number of active intervals; where it leaves 0 a ``period`` begins, where it
    returns to 0 it ends, and the stretch up to the next period is a ``gap``.
    Intervals that only touch belong to one period, as a tick's plus and minus
    events count together. ``n`` is the number of intervals of a period (0 for gaps).

    Scale: the prefix sum runs in blocks of ``block_ms`` ticks, so a key with a
    third of all rows is spread over its blocks; only one total and at most two
    boundary rows per block are ordered per key.

    Edge cases: rows with a null key or bound, or an end not after the start,
    are left out; repeated rows count each; an empty table gives no row.
    """
    k, b = F.col("key"), F.col("b")
    valid = intervals.select(F.col(key).alias("key"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).where(k.isNotNull() & (F.col("e") > F.col("s")))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ticks = (
        valid.select("key", F.explode(F.array(F.struct(F.col("s").alias("t"), one.alias("up"), zero.alias("down")), F.struct(F.col("e").alias("t"), zero.alias("up"), one.alias("down")))).alias("x"))
        .select("key", "x.*")
        .withColumn("b", F.floor(F.col("t") / F.lit(block_ms)).cast("bigint"))
        .groupBy("key", "b", "t")
        .agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    )
    before = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ticks.groupBy("key", "b")
        .agg(F.sum(F.col("up") - F.col("down")).alias("net"), F.sum("up").alias("ups"))
        .select("key", "b", F.coalesce(F.sum("net").over(before), zero).alias("off"), F.coalesce(F.sum("ups").over(before), zero).alias("ups_off"))
    )
    inside = Window.partitionBy("key", "b").orderBy("t")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = (
        ticks.withColumn("run", F.sum(F.col("up") - F.col("down")).over(upto))
        .withColumn("ups", F.sum("up").over(upto))
        .join(offsets, ["key", "b"])
        .withColumn("after", F.col("run") + F.col("off"))
        .withColumn("begins", F.col("after") - F.col("up") + F.col("down") == 0)
        .where(F.col("begins") | (F.col("after") == 0))
        .select("key", "b", "t", "begins", (F.col("ups") + F.col("ups_off") - F.when(F.col("begins"), F.col("up")).otherwise(zero)).alias("c"))
    )
    nxt = F.struct("t", "c")
    edges = swept.withColumn("nxt", F.lead(nxt).over(inside)).withColumn("head", F.lag("t").over(inside).isNull())
    across = Window.partitionBy("key").orderBy("t")
    joined = (
        edges.where(F.col("head") | F.col("nxt").isNull())
        .withColumn("far", F.lead(nxt).over(across))
        .where(F.col("nxt").isNull() & F.col("far").isNotNull())
        .select("key", "t", "begins", "c", F.col("far").alias("nxt"))
    )
    return (
        edges.where(F.col("nxt").isNotNull())
        .select("key", "t", "begins", "c", "nxt")
        .unionByName(joined)
        .select(
            "key",
            F.when(F.col("begins"), F.lit("period")).otherwise(F.lit("gap")).alias("kind"),
            F.col("t").alias("start_ms"),
            F.col("nxt.t").alias("end_ms"),
            F.when(F.col("begins"), F.col("nxt.c") - F.col("c")).otherwise(zero).alias("n"),
        )
    )


def segment_bounds(manifest: DataFrame) -> DataFrame:
    """One row ``(audio_id, rec_id, start_ms, end_ms)`` per segment id of a manifest.

    Of several deliveries of an id the latest by ``ingested_at`` counts (null is
    earliest; ties: the greatest bounds). Rows with a null id are left out."""
    bounds = F.struct(F.coalesce(F.col("ingested_at").cast("timestamp"), F.timestamp_micros(F.lit(0))).alias("at"), to_ms(F.col("seg_start")).alias("s"), to_ms(F.col("seg_end")).alias("e"))
    one = manifest.select(norm_key("audio_id").alias("audio_id"), bounds.alias("x")).where(F.col("audio_id").isNotNull()).groupBy("audio_id").agg(F.max("x").alias("x"))
    return one.select("audio_id", rec_of("audio_id").alias("rec_id"), F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"))


def speech_periods(manifest: DataFrame, min_segments: int = 2, min_gap_ms: int = 1_000, max_gap_ms: int = 600_000) -> DataFrame:
    """``(rec_id, kind, start_ms, end_ms)``: the periods of at least ``min_segments``
    segments of each recording, and the gaps longer than ``min_gap_ms`` and at
    most ``max_gap_ms`` between its successive periods."""
    r = periods_and_gaps(segment_bounds(manifest), "rec_id")
    length = F.col("end_ms") - F.col("start_ms")
    keep = F.when(F.col("kind") == "period", F.col("n") >= min_segments).otherwise((length > min_gap_ms) & (length <= max_gap_ms))
    return r.where(keep).select(F.col("key").alias("rec_id"), "kind", "start_ms", "end_ms")
