"""Audio samples as arrays: framing, levels, gain, trimming, silence and cover colours, native where the engine can."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from vellum.functions.arrow import arrow_udf
from vellum.functions.text import C, col

# Levels in dBFS, margins in milliseconds.
TARGET_DB, PEAK_DB, SAME_DB = -18.71, -1.5, 0.05
FLOOR_DB, QUIET_DB, TRIM_DB = -90.0, -40.0, -45.0
FRAME_MS, HOP_MS, HEAD_MS, TAIL_MS = 20, 10, 60, 140
DEFAULT_RATE = 24_000


def frames(samples: C, frame: int, hop: int) -> Column:
    """Overlapping windows; a signal shorter than a frame is one."""
    x = col(samples)
    starts = F.sequence(F.lit(1), F.size(x) - frame + 1, F.lit(hop))
    return F.when(F.size(x) < frame, F.array(x)).otherwise(F.transform(starts, lambda s: F.slice(x, s, frame)))


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.sqrt(total / F.size(samples))


def decibels(level: Column) -> Column:
    return 20 * F.log10(F.greatest(level, F.lit(1e-12)))


def frame_levels(samples: C, frame: int, hop: int) -> Column:
    """The level of each window in dBFS, clipped to [-90, 0]."""
    return F.transform(frames(samples, frame, hop), lambda w: F.least(F.lit(0.0), F.greatest(F.lit(FLOOR_DB), decibels(rms(w)))))


def peak_db(samples: C) -> Column:
    return decibels(F.array_max(F.transform(col(samples), lambda v: F.abs(v.cast("double")))))


def gain_db(active: C, peak: C) -> Column:
    """The gain that brings speech to the target level without clipping."""
    return F.least(F.lit(TARGET_DB) - col(active), F.lit(PEAK_DB) - col(peak))


def needs_gain(gain: C) -> Column:
    return F.abs(col(gain)) >= SAME_DB


def with_gain(samples: C, gain: C) -> Column:
    factor = F.pow(F.lit(10.0), col(gain) / 20)
    return F.when(needs_gain(gain), F.transform(col(samples), lambda v: (v * factor).cast("float"))).otherwise(col(samples))


def silence(ms: C, rate: C) -> Column:
    """Zero samples: at least one when the duration is above 0."""
    n = F.greatest(F.lit(1), F.round(col(rate) * col(ms) / 1000).cast("int"))
    return F.when((col(ms) > 0) & (col(rate) > 0), F.array_repeat(F.lit(0.0).cast("float"), n)).otherwise(F.array().cast("array<float>"))


def sample_rate(*given: C) -> Column:
    """The first rate above 0, else 24 kHz."""
    return F.coalesce(*(F.when(col(c) > 0, col(c)) for c in given), F.lit(DEFAULT_RATE))


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The threshold that parts values into two classes best, the lowest of equals; -40 without values, the value itself when they are all one."""
    if not len(values):
        return QUIET_DB
    low, high = float(values.min()), float(values.max())
    if high - low < 1e-9:
        return low
    counts, edges = np.histogram(values, bins, (low, high))
    centres = (edges[:-1] + edges[1:]) / 2
    below = np.cumsum(counts)
    above = below[-1] - below
    mass = np.cumsum(counts * centres)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    between = np.where((below > 0) & (above > 0), between, -1.0)
    return float(centres[int(np.argmax(between >= between.max() * (1 - 1e-9)))])


def active_level(samples: np.ndarray, rate: int) -> tuple[float, float]:
    """(level of the frames with speech, peak) in dBFS."""
    frame, hop = max(1, rate * FRAME_MS // 1000), max(1, rate * HOP_MS // 1000)
    x = samples.astype("float64")
    if len(x) < frame:
        windows = x[None, :] if len(x) else np.zeros((1, 1))
    else:
        windows = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    power = (windows**2).mean(1)
    level = np.clip(10 * np.log10(power + 1e-12), FLOOR_DB, 0.0)
    chosen = power[level >= otsu(level)]
    if not len(chosen):
        chosen = power[level > QUIET_DB]
    if not len(chosen):
        chosen = power
    peak = np.abs(x).max() if len(x) else 0.0
    return float(10 * np.log10(chosen.mean() + 1e-12)), float(20 * np.log10(peak + 1e-12))


def trim_bounds(samples: np.ndarray, rate: int) -> tuple[int, int]:
    """Where speech stands within its margins; the whole signal when no frame is loud enough."""
    n = len(samples)
    frame, hop = max(1, rate * FRAME_MS // 1000), max(1, rate * HOP_MS // 1000)
    if n < frame:
        return 0, n
    windows = np.lib.stride_tricks.sliding_window_view(samples.astype("float64"), frame)[::hop]
    loud = np.flatnonzero(20 * np.log10(np.sqrt((windows**2).mean(1)) + 1e-12) > TRIM_DB)
    if not len(loud):
        return 0, n
    return max(0, int(loud[0]) * hop - rate * HEAD_MS // 1000), min(n, int(loud[-1]) * hop + frame + rate * TAIL_MS // 1000)


@arrow_udf("double")
def otsu_threshold(values: pd.Series) -> pd.Series:
    """The Otsu threshold of each array."""
    return values.map(lambda v: otsu(np.asarray(v, "float64")) if v is not None else None)


@arrow_udf("active_db double, peak_db double", once=True)
def speech_level(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """The level of active speech and the peak of each signal."""
    return pd.DataFrame([active_level(np.asarray(s), int(r)) if s is not None else (None, None) for s, r in zip(samples, rate)], columns=["active_db", "peak_db"])


@arrow_udf("array<float>")
def trimmed(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Each signal without the silence around it."""

    def one(s, r):
        if s is None:
            return None
        a, b = trim_bounds(np.asarray(s), int(r))
        return s[a:b]

    return pd.Series([one(s, r) for s, r in zip(samples, rate)])


@arrow_udf("binary")
def sound_file(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Each signal as a mono sound file of 16 bits a sample; what is beyond full scale is clipped."""
    import io
    import wave

    def one(s, r) -> bytes | None:
        if s is None:
            return None
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(int(r))
            w.writeframes((np.clip(np.asarray(s, "float64"), -1, 1) * 32767).round().astype("<i2").tobytes())
        return out.getvalue()

    return pd.Series([one(s, r) for s, r in zip(samples, rate)], dtype=object)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(c).cast("int")))


def mixed(rgb: C, towards: int, share: float) -> Column:
    """A colour mixed with white (255) or black (0)."""
    return F.transform(col(rgb), lambda v: clamp(v * (1 - share) + towards * share))


def cover_gradient(rgb: C) -> Column:
    """The light and dark ends of a cover's gradient."""
    return F.struct(mixed(rgb, 255, 0.22).alias("light"), mixed(rgb, 0, 0.18).alias("dark"))
