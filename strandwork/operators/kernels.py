"""Signal kernels: numpy inside Arrow tasks, one group a signal; closed forms stay columns.

A signal is samples of one stem. `per_signal` gathers the chunks of a signal, which is bounded by its trimmed length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def per_signal(chunks: DataFrame, key: Sequence[str], kernel: Callable[[np.ndarray, int], np.ndarray], chunk: str = "chunk", rate: str = "rate", samples: str = "samples") -> DataFrame:
    """Apply kernel(samples, rate) to each signal of (key, chunk, rate, samples); same columns out, one chunk a signal."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(chunk)
        x = np.concatenate([np.asarray(s, np.float64) for s in pdf[samples]]) if len(pdf) else np.zeros(0)
        out = kernel(x, int(pdf[rate].iloc[0]))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in key}, chunk: [0], rate: [int(pdf[rate].iloc[0])], samples: [np.asarray(out, np.float64).tolist()]})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.select(*key).schema.fields)
    return chunks.select(*key, chunk, rate, samples).groupBy(*key).applyInPandas(one, f"{kinds}, {chunk} int, {rate} int, {samples} array<double>")


def follow(target: np.ndarray, falling: float, rising: float) -> np.ndarray:
    """One-pole smoothing whose coefficient depends on the direction: `falling` towards lower targets, `rising` towards others."""
    out = np.empty(len(target))
    last = target[0] if len(target) else 0.0
    for i, x in enumerate(target):
        c = falling if x < last else rising
        last = x if i == 0 else c * last + (1 - c) * x
        out[i] = last
    return out


def spread(values: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Frame values between their centres, held at the ends."""
    return np.interp(np.arange(n), centres, values)


def frame_rms(x: np.ndarray, length: int) -> np.ndarray:
    n = len(x) // length
    return np.sqrt((x[: n * length].reshape(n, length) ** 2).mean(1) + 1e-20)


def compress(x: np.ndarray, rate: int, threshold_db: float = -18.0, ratio: float = 3.0, attack_ms: float = 10.0, release_ms: float = 100.0, makeup_db: float = 3.0, gate_db: float = -50.0) -> np.ndarray:
    """Gain by 10 ms levels: over the threshold by the ratio, make-up where the gate is open, both smoothed."""
    length = max(1, rate // 100)
    if len(x) < length:
        return x
    db = 20 * np.log10(frame_rms(x, length) + 1e-20)
    cut = np.where(db > threshold_db, -(db - threshold_db) * (1 - 1 / ratio), 0.0)
    cut[db < gate_db] = 0.0
    attack, release = (np.exp(-1.0 / max(1, ms / 10)) for ms in (attack_ms, release_ms))
    gain_db = follow(cut, attack, release) + makeup_db * -follow(-(db >= gate_db).astype(float), attack, release)
    return x * spread(10 ** (gain_db / 20), np.arange(len(db)) * length + length // 2, len(x))


#: Centres of third-octave bands in Hz (ISO 266), 20 Hz to 20 kHz.
BANDS = (20, 25, 31.5, 40, 50, 63, 80, 100, 125, 160, 200, 250, 315, 400, 500, 630, 800, 1000, 1250, 1600, 2000, 2500, 3150, 4000, 5000, 6300, 8000, 10000, 12500, 16000, 20000)


def spectrum(x: np.ndarray, rate: int, n: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(Hz, dB) power density by averaged half-overlapping Hann windows without their means, floor -120 dB."""
    x = np.pad(x, (0, max(0, n - len(x))))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[:: n // 2]
    power = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * window)) ** 2
    density = power.mean(0) / (rate * (window**2).sum())
    density[1:-1] *= 2
    return np.fft.rfftfreq(n, 1 / rate), 10 * np.log10(np.maximum(density, 1e-12))


SIXTH = 2 ** (1 / 6)


def band_spectrum(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, dB) of the third-octave bands [centre / 2^(1/6), centre * 2^(1/6)) that a spectrum reaches: mean power of their bins.

    Where bands of rounded centres overlap, a bin is the lower band's.
    """
    hz, db = spectrum(x, rate)
    centres = np.array(BANDS)
    low, high = centres / SIXTH, centres * SIXTH
    place = np.searchsorted(high, hz, "right")
    inside = (place < len(BANDS)) & (hz >= low[np.minimum(place, len(BANDS) - 1)])
    count = np.bincount(place[inside], minlength=len(BANDS))
    power = np.bincount(place[inside], 10 ** (db[inside] / 10), len(BANDS))
    there = np.flatnonzero(count)
    return there, 10 * np.log10(np.maximum(power[there] / count[there], 1e-12))


def band_profiles(signals: DataFrame, key: str, rate: str = "rate", samples: str = "samples", silence: float = -120.0) -> DataFrame:
    """(key, band, db, relative_db) of signals that are one row each, with no shuffle: levels and their distance from the mean level of bands above silence."""
    kind = signals.schema[key].dataType.simpleString()

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for name, hz, x in zip(*(batch.column(k) for k in range(3))):
                band, db = band_spectrum(x.values.to_numpy(zero_copy_only=False).astype(float) if x.is_valid else np.zeros(0), hz.as_py())
                loud = db[db > silence + 1]
                mean = loud.mean() if len(loud) else silence
                for column, values in zip(out, ([name.as_py()] * len(band), band, db, db - mean)):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int32()), *(pa.array(c, pa.float64()) for c in out[2:])], [key, "band", "db", "relative_db"])

    return signals.select(key, rate, F.col(samples).cast("array<double>")).mapInArrow(levels, f"{key} {kind}, band int, db double, relative_db double")


def soft_clip(x: Column, ceiling: float, knee_db: float = 4.0) -> Column:
    """Unchanged below the knee, a tanh curve above it."""
    t = ceiling / 10 ** (knee_db / 20)
    bent = F.signum(x) * (t + (ceiling - t) * F.tanh((F.abs(x) - t) / (ceiling - t)))
    return F.when(F.abs(x) <= t, x).otherwise(bent)


def fade(i: Column, n: Column, fade_in: int, fade_out: int) -> Column:
    """Cosine-squared gain of sample i of n: from 0 over the first, to 0 over the last samples."""
    a, b = F.least(F.lit(fade_in), n), F.least(F.lit(fade_out), n)
    up = F.when(i < a, F.pow(F.cos(F.pi() / 2 * (1 - F.try_divide(i.cast("double"), F.greatest(a - 1, F.lit(1))))), F.lit(2.0))).otherwise(F.lit(1.0))
    down = F.when(i >= n - b, F.pow(F.cos(F.pi() / 2 * F.try_divide((i - (n - b)).cast("double"), F.greatest(b - 1, F.lit(1)))), F.lit(2.0))).otherwise(F.lit(1.0))
    return up * down


def bus(stems: DataFrame, key: Sequence[str], chunk: str, samples: str, gain: str) -> DataFrame:
    """(key, chunk, samples): sum of the stems' chunks by place, each by its gain; short ones count as silence at their end."""
    flat = stems.select(*key, chunk, F.col(gain).alias("_g"), F.posexplode(samples).alias("_i", "_x"))
    summed = flat.groupBy(*key, chunk, "_i").agg(F.sum(F.col("_x") * F.col("_g")).alias("_s"))
    return summed.groupBy(*key, chunk).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda p: p["_s"]).alias(samples))
