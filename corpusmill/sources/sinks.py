"""Sinks: datasets, drop logs, cards and results. Inputs are never overwritten."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import materialize


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_dataset(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("split",), force: bool = False) -> bool:
    """Parquet by split; nothing is done where the path exists, unless ``force``."""
    if not force and exists(df.sparkSession, path):
        return False
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return True


def write_back(df: DataFrame, path: str) -> None:
    """Puts ``df`` in the place of the parquet table at ``path``, which it may have been read from:
    it is written beside it, then the folders are swapped. The old one goes last, so that a
    failure leaves one whole table at ``path`` or beside it."""
    spark, tag = df.sparkSession, uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.new-{tag}", f"{path.rstrip('/')}.old-{tag}"
    df.write.parquet(new)
    jvm = spark.sparkContext._jvm
    at, fresh, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at) and not fs.rename(at, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(fresh, at):
        fs.rename(aside, at)
        raise OSError(f"could not move {new} to {path}")
    fs.delete(aside, True)


def write_segments(df: DataFrame, folder: str, kept_only: bool = True) -> None:
    """The manifest (all rows without waveform) and the waveforms of kept, valid rows. ``df`` is
    computed once, into the shared folder; both are read from there."""
    d = materialize(df, "segments")
    d.drop("waveform").write.mode("overwrite").parquet(f"{folder}/manifest")
    w = d.where((F.col("kept") if kept_only else F.lit(True)) & F.col("waveform").isNotNull() & (F.size("waveform") > 0))
    w.select("audio_id", "waveform", "sample_rate", "duration_s").write.mode("overwrite").parquet(f"{folder}/waveforms")


def drop_log(dropped: DataFrame, reason: str = "too_short", phase: int = 1) -> DataFrame:
    """``(split, audio_id, phase, reason, transcript_nota, char_len)`` of dropped rows."""
    return dropped.select("split", "audio_id", F.lit(phase).alias("phase"), F.lit(reason).alias("reason"), "transcript_nota", F.coalesce(F.length("transcript_nota"), F.lit(0)).alias("char_len"))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def card(stats: DataFrame, title: str) -> str:
    """A text card of a table of statistics, all its rows; it is read a partition at a time."""
    return "\n".join([f"# {title}", "", *[" | ".join(f"{k}: {v}" for k, v in r.asDict().items()) for r in stats.toLocalIterator()]])


def audit_report(parts: dict[str, DataFrame], title: str) -> str:
    """Cards of several tables under their names."""
    return "\n\n".join([f"# {title}", *[card(d, name) for name, d in parts.items()]])


def _write_text(spark: SparkSession, path: str, pieces) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for x in pieces:
            out.write(bytearray(x.encode("utf-8")))
    finally:
        out.close()


def write_metadata(spark: SparkSession, path: str, raw: DataFrame, cleaned: DataFrame, sources: list[str], stage: str) -> dict:
    """Counts of a corpus before and after cleaning, the time and the sources, as a JSON file."""
    meta = {"source": stage, "raw_samples": raw.count(), "cleaned_samples": cleaned.count(), "cleaning_date": datetime.now(timezone.utc).isoformat(), "sources": sources}
    _write_text(spark, path, [json.dumps(meta, indent=2, ensure_ascii=False)])
    return meta


def write_kb(entries: DataFrame, path: str, order: str = "id") -> None:
    """A knowledge base as one file of one JSON array, in the order of the ids; entries are
    fetched a partition at a time, as a file has one writer."""

    def pieces():
        yield "["
        first = True
        for r in entries.orderBy(order).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            yield ("\n" if first else ",\n") + r["j"]
            first = False
        yield "\n]\n"

    _write_text(entries.sparkSession, path, pieces())


def write_metrics(one: DataFrame, path: str) -> dict:
    """The single row of ``one`` as a JSON object."""
    rows = one.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("metrics are one row")
    _write_text(one.sparkSession, path, [json.dumps(rows[0].asDict(recursive=True), indent=2, ensure_ascii=False, default=str)])
    return rows[0].asDict(recursive=True)
