"""Resampling by chunks against the whole signal, at chunk edges too."""

import math

import numpy as np
import pytest

from strandwork.operators import resampling
from strandwork.operators.resampling import chunked, resampled

KEYS = ["k"]


def whole(x, rate, wanted, half=resampling.HALF):
    """A plain loop over the outputs of a whole signal."""
    common = math.gcd(rate, wanted)
    up, down, side, cut = wanted // common, rate // common, math.ceil(half * max(1.0, rate / wanted)), min(1.0, wanted / rate)
    out = []
    for m in range(-(-len(x) * up // down)):
        i, p = divmod(m * down, up)
        n = np.arange(i - side + 1, i + side + 1)
        d = i + p / up - n
        w = np.sinc(cut * d) * np.cos(d * np.pi / (2 * side)) ** 2
        inside = (n >= 0) & (n < len(x))
        out.append(float((w[inside] * x[n[inside]]).sum() / w.sum()))
    return np.array(out)


def run(spark, signals, rate, wanted, size):
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)], "k string, at long, v double").repartition(3)
    out = {k: [] for k in signals}
    for r in sorted(resampled(chunked(rows, KEYS, "at", "v", size), KEYS, rate, wanted, size).collect(), key=lambda r: r["first"]):
        assert r["first"] == len(out[r["k"]])
        out[r["k"]] += r["samples"]
    return out


@pytest.mark.parametrize("rate,wanted,size", [(48000, 44100, 32), (44100, 48000, 40), (22050, 44100, 16), (44100, 22050, 64), (3, 1, 50), (8000, 8000, 7)])
def test_chunks_equal_the_whole_signal(spark, rate, wanted, size):
    rng = np.random.default_rng(size)
    signals = {"long": rng.normal(size=301), "one": rng.normal(size=1), "edge": rng.normal(size=size), "over": rng.normal(size=size + 1)}
    got = run(spark, signals, rate, wanted, size)
    for k, x in signals.items():
        want = x if rate == wanted else whole(x, rate, wanted)
        assert len(got[k]) == len(want) and np.allclose(got[k], want, atol=1e-9), k


def test_a_tone_keeps_its_pitch_and_a_level_its_height(spark):
    t = np.arange(2000)
    got = run(spark, {"tone": np.sin(2 * np.pi * t * 440 / 48000), "level": np.ones(2000)}, 48000, 44100, 128)
    m = np.arange(len(got["tone"]))
    assert np.abs(np.array(got["tone"]) - np.sin(2 * np.pi * m * 440 / 44100))[100:-100].max() < 1e-3
    assert np.abs(np.array(got["level"])[50:-50] - 1).max() < 1e-9


def test_chunks_shorter_than_the_reach_are_refused(spark):
    with pytest.raises(ValueError):
        run(spark, {"a": np.ones(20)}, 2, 1, 20)
