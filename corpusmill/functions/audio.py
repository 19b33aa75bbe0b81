"""Waveform functions on arrays of samples, and Arrow functions for codecs.

Null arrays give null; empty arrays give the stated zero values."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _d(a: Column) -> Column:
    return a.cast("array<double>")


def rms(a: Column) -> Column:
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x) / F.size(a)))


def peak(a: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(_d(a), lambda x: F.abs(x))), F.when(a.isNotNull(), F.lit(0.0)))


def silence_ratio(a: Column, threshold: float = 0.01) -> Column:
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.filter(_d(a), lambda x: F.abs(x) < threshold)) / F.size(a))


def segment_quality(a: Column, rate: Column) -> Column:
    """``struct(duration_s, rms, peak, silence_ratio, n_samples)``, rounded to 4, 6, 6, 4 places."""
    n = F.size(a)
    return F.struct(
        F.round(n / F.nullif(rate, F.lit(0)), 4).alias("duration_s"), F.round(rms(a), 6).alias("rms"), F.round(peak(a), 6).alias("peak"), F.round(silence_ratio(a), 4).alias("silence_ratio"), n.alias("n_samples")
    )


def quality_gate(duration: Column, level: Column, silence: Column, min_s: float = 0.5, max_s: float = 20.0, min_rms: float = 0.001, max_silence: float = 0.9) -> Column:
    """The first reason that drops a segment, else ``ok``. Null measures fail no rule."""
    return F.when(duration < min_s, "too_short").when(duration > max_s, "too_long").when(level < min_rms, "too_silent").when(silence > max_silence, "mostly_silent").otherwise("ok")


def is_valid(a: Column, rate: Column) -> Column:
    return a.isNotNull() & (F.size(a) > 0) & F.coalesce(rate > 0, F.lit(False))


def slice_segment(a: Column, rate: Column, start_s: Column, end_s: Column, rounded: bool = False) -> Column:
    """Samples from ``start_s`` up to ``end_s``, both clamped to the array."""
    at = (lambda x: F.bround(x * rate).cast("int")) if rounded else (lambda x: (x * rate).cast("int"))
    first = F.least(F.greatest(at(start_s), F.lit(0)), F.size(a))
    last = F.least(F.greatest(at(end_s), first), F.size(a))
    return F.slice(a, first + 1, last - first)


def to_mono(frames: Column) -> Column:
    """The mean over the channels of each frame."""
    return F.transform(frames, lambda f: F.aggregate(_d(f), F.lit(0.0), lambda s, x: s + x) / F.size(f))


def peak_normalize(a: Column, level: float = 0.95) -> Column:
    p = peak(a)
    return F.when(p > 0, F.transform(_d(a), lambda x: x * level / p)).otherwise(_d(a))


def pre_emphasis(a: Column, coef: float = 0.97) -> Column:
    d = _d(a)
    return F.transform(d, lambda x, i: F.when(i == 0, x).otherwise(x - coef * F.get(d, i - 1)))


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and the rate of PCM WAV bytes of 8, 16, 24 or 32 bits; empty and
    unreadable bytes and other widths give none."""
    if not data:
        return np.zeros(0, np.float32), 0
    try:
        with wave.open(io.BytesIO(data)) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32), 0
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 3, 4):
        raw = raw[: len(raw) - len(raw) % width]
        if width == 3:  # as the upper bytes of 32 bits
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
            raw, width = np.concatenate([np.zeros((len(b), 1), np.uint8), b], 1).tobytes(), 4
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    else:
        return np.zeros(0, np.float32), 0
    x = x[: len(x) - len(x) % channels]
    return x.reshape(-1, channels).mean(1).astype(np.float32), rate


def encode_wav(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """16-bit PCM; samples of several channels are interleaved."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 32767 / 32768) * 32768).round().astype("<i2").tobytes())
    return out.getvalue()


def cut_wav(data: bytes | None, start_s: float | None, end_s: float | None) -> bytes | None:
    """WAV bytes of the samples from ``start_s`` up to ``end_s``; null for null or unreadable
    bytes and null bounds."""
    x, rate = decode_wav(data)
    if not rate or start_s is None or end_s is None or start_s != start_s or end_s != end_s:
        return None
    first = min(max(int(start_s * rate), 0), len(x))
    return encode_wav(x[first : max(first, min(int(end_s * rate), len(x)))], rate)


def resample(x: np.ndarray, rate: int, target: int, taps: int = 32) -> np.ndarray:
    """Band-limited resampling: each new sample is the sum of the samples around its place,
    weighted by a sinc below both Nyquist frequencies under a Kaiser window of ``taps`` zero
    crossings on either side. The ends are padded by their own samples."""
    if rate == target or not len(x) or rate <= 0:
        return x
    cut = min(1.0, target / rate)
    half = int(np.ceil(taps / cut))
    padded = np.pad(x.astype(np.float64), half, mode="edge")
    n = max(1, round(len(x) * target / rate))
    out = np.empty(n, np.float32)
    around = np.arange(-half + 1, half + 1)
    for lo in range(0, n, 8192):
        at = np.arange(lo, min(n, lo + 8192)) * (rate / target)
        base = np.floor(at).astype(np.int64)
        d = at[:, None] - (base[:, None] + around)
        w = np.sinc(d * cut) * np.i0(8.6 * np.sqrt(np.clip(1 - (d / half) ** 2, 0, None)))
        w /= w.sum(1, keepdims=True)
        out[lo : lo + len(at)] = (padded[np.clip(base[:, None] + around + half, 0, len(padded) - 1)] * w).sum(1)
    return out


def trim_silence(x: np.ndarray, top_db: float = 30, frame: int = 512, hop: int = 128, least: int = 100) -> np.ndarray:
    """Without the outer frames that lie ``top_db`` below the loudest; as it was if fewer than ``least`` samples stay."""
    if len(x) < frame:
        return x
    upto = np.concatenate([[0.0], np.cumsum(np.pad(x.astype(np.float64), frame // 2) ** 2)])
    first = np.arange(0, len(upto) - frame, hop)
    power = np.maximum(upto[first + frame] - upto[first], 0) / frame
    loud = np.flatnonzero(10 * np.log10(np.maximum(power, 1e-10) / max(power.max(), 1e-10)) > -top_db)
    if not len(loud):
        return x
    cut = x[loud[0] * hop : min(len(x), (loud[-1] + 1) * hop)]
    return cut if len(cut) >= least else x


@F.pandas_udf(T.StructType([T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("rate", T.IntegerType())]))
def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``struct(samples, rate)`` of WAV bytes."""
    for s in parts:
        got = [decode_wav(b) for b in s]
        yield pd.DataFrame({"samples": [x for x, _ in got], "rate": [r for _, r in got]})


@F.pandas_udf(T.BinaryType())
def encoded(samples: pd.Series, rates: pd.Series, channels: pd.Series) -> pd.Series:
    """16-bit WAV bytes of (interleaved) samples; null for null."""
    return pd.Series([None if x is None else encode_wav(np.asarray(x, np.float32), int(r), int(c)) for x, r, c in zip(samples, rates, channels, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def sliced(data: pd.Series, start_s: pd.Series, end_s: pd.Series) -> pd.Series:
    """WAV bytes between two seconds of WAV bytes; see ``cut_wav``."""
    return pd.Series([cut_wav(None if b is None else bytes(b), s, e) for b, s, e in zip(data, start_s, end_s, strict=True)], dtype=object)


def preprocess(rate: int = 16_000, trim: bool = True, normalize: bool = True, emphasis: bool = True):
    """An Arrow function from (samples, rate) to samples: resampled, trimmed, normalised, emphasised."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(samples: pd.Series, rates: pd.Series) -> pd.Series:
        out = []
        for x, r in zip(samples, rates, strict=True):
            if x is None:
                out.append(None)
                continue
            y = resample(np.asarray(x, np.float32), int(r or 0), rate)
            y = trim_silence(y) if trim else y
            top = np.abs(y).max() if len(y) else 0
            y = y * (0.95 / top) if normalize and top > 0 else y
            y = np.append(y[:1], y[1:] - 0.97 * y[:-1]) if emphasis and len(y) else y
            out.append(y.astype(np.float32))
        return pd.Series(out)

    return run
