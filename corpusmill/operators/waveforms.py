"""Segments cut from recordings' bytes, with measures and the quality gate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import audio

#: Segments of one recording that a task cuts from one decoding of it.
CHUNK = 500


def _cutter(rate: int, options: dict, gate: dict):
    def measure(x: np.ndarray, r: int) -> tuple:
        n = len(x)
        d = round(n / r, 4) if r > 0 else 0.0
        level = round(float(np.sqrt(np.mean(x.astype(np.float64) ** 2))), 6) if n else 0.0
        top = round(float(np.abs(x).max()), 6) if n else 0.0
        quiet = round(float((np.abs(x) < 0.01).mean()), 4) if n else 1.0
        g = {"min_s": 0.5, "max_s": 20.0, "min_rms": 0.001, "max_silence": 0.9} | gate
        rules = ((d < g["min_s"], "too_short"), (d > g["max_s"], "too_long"), (level < g["min_rms"], "too_silent"), (quiet > g["max_silence"], "mostly_silent"))
        return d, level, top, quiet, next((name for hit, name in rules if hit), "ok")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec, data, segs in zip(pdf["rec_id"], pdf["bytes"], pdf["segs"], strict=True):
                x, r = audio.decode_wav(bytes(data)) if data is not None else (np.zeros(0, np.float32), 0)
                rows = []
                for s in segs:
                    y, reason = np.zeros(0, np.float32), "recording_not_found" if data is None else "decode_failed"
                    d, level, top, quiet = 0.0, 0.0, 0.0, 1.0
                    if r > 0 and s["seg_start"] is not None and s["seg_end"] is not None:
                        a = min(max(int(s["seg_start"] * r), 0), len(x))
                        y = audio.resample(x[a : max(a, min(int(s["seg_end"] * r), len(x)))], r, rate)
                        y = audio.trim_silence(y) if options.get("trim", True) else y
                        if options.get("normalize", True) and len(y) and np.abs(y).max() > 0:
                            y = y * (0.95 / np.abs(y).max())
                        if options.get("emphasis", False) and len(y):
                            y = np.append(y[:1], y[1:] - 0.97 * y[:-1])
                        d, level, top, quiet, reason = measure(y, rate)
                    elif r > 0:
                        reason = "no_bounds"
                    rows.append((s["audio_id"], rec, y.astype(np.float32), rate, d, level, top, quiet, reason == "ok", reason))
                if rows:
                    yield pd.DataFrame(rows, columns=["audio_id", "rec_id", "waveform", "sample_rate", "duration_s", "rms", "peak", "silence_ratio", "kept", "drop_reason"])

    return run


def extract_segments(recordings: DataFrame, segments: DataFrame, rate: int = 16_000, options: dict | None = None, gate: dict | None = None) -> DataFrame:
    """Waveform, measures, ``kept`` and ``drop_reason`` of each segment.

    ``recordings``: ``(rec_id, bytes)`` with each id once; ``segments``: ``(audio_id, rec_id,
    seg_start, seg_end)``. A recording is decoded once per ``CHUNK`` of its segments, so a hot
    recording is spread over tasks and no group is unbounded. Missing recordings, unreadable
    bytes and null bounds keep their row, with a reason. WAV PCM only."""
    chunk = F.pmod(F.xxhash64("audio_id"), F.greatest(F.lit(1), F.ceil(F.col("_n") / CHUNK)).cast("bigint"))
    sizes = segments.groupBy("rec_id").agg(F.count("*").alias("_n"))
    packed = segments.join(sizes, "rec_id").groupBy("rec_id", chunk.alias("_c")).agg(F.collect_list(F.struct("audio_id", "seg_start", "seg_end")).alias("segs"))
    both = packed.join(recordings.select("rec_id", "bytes"), "rec_id", "left").select("rec_id", "bytes", "segs")
    schema = "audio_id string, rec_id string, waveform array<float>, sample_rate int, duration_s double, rms double, peak double, silence_ratio double, kept boolean, drop_reason string"
    return both.mapInPandas(_cutter(rate, options or {}, gate or {}), schema)


def wav_info(df: DataFrame, key: str, data: str) -> DataFrame:
    """``(key, channels, sample_rate, seconds)`` from the heads of WAV bytes; null for unreadable ones."""
    import io
    import wave

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, b in zip(pdf["k"], pdf["b"], strict=True):
                try:
                    with wave.open(io.BytesIO(bytes(b))) as w:
                        rows.append((k, w.getnchannels(), w.getframerate(), w.getnframes() / w.getframerate()))
                except (wave.Error, EOFError, TypeError):
                    rows.append((k, None, None, None))
            if rows:
                yield pd.DataFrame(rows, columns=["k", "channels", "sample_rate", "seconds"]).astype({"channels": "Int32", "sample_rate": "Int32"})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(data).alias("b")).mapInPandas(run, f"k {kind}, channels int, sample_rate int, seconds double").withColumnRenamed("k", key)


def channel_census(info: DataFrame) -> DataFrame:
    """``(kind, n)``: mono, multi and invalid recordings."""
    kind = F.when(F.col("channels").isNull(), "invalid").when(F.col("channels") == 1, "mono").otherwise("multi")
    return info.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
