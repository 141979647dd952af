"""Signal kernels against plain loops and against theory."""

import math

import numpy as np

from conftest import SF001
from strandwork.operators import kernels
from strandwork.plans import catalogue

RATE = 8000


def sine(hz, seconds, amplitude=0.5, rate=RATE):
    return amplitude * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def plain_follow(target, falling, rising):
    out = [target[0]]
    for x in target[1:]:
        c = falling if x < out[-1] else rising
        out.append(c * out[-1] + (1 - c) * x)
    return out


def test_compressor_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000) * np.repeat(rng.choice([0.001, 0.05, 0.6], 40), 100)
    got, n = kernels.compress(x, RATE), 80
    db = [20 * math.log10(math.sqrt((x[i * n : i * n + n] ** 2).mean() + 1e-20) + 1e-20) for i in range(len(x) // n)]
    cut = [0.0 if d < -50 or d <= -18 else -(d + 18) * (1 - 1 / 3) for d in db]
    attack, release = math.exp(-1.0), math.exp(-0.1)
    opened = [-v for v in plain_follow([-(1.0 if d >= -50 else 0.0) for d in db], attack, release)]
    gain = [10 ** ((c + 3 * o) / 20) for c, o in zip(plain_follow(cut, attack, release), opened)]
    centres = [k * n + n // 2 for k in range(len(db))]

    def at(i):
        if i <= centres[0]:
            return gain[0]
        if i >= centres[-1]:
            return gain[-1]
        k = max(k for k in range(len(centres)) if centres[k] <= i)
        return gain[k] + (gain[k + 1] - gain[k]) * (i - centres[k]) / n if centres[k] < i else gain[k]

    assert np.allclose(got, [v * at(i) for i, v in enumerate(x)])


def test_band_of_a_sine_is_that_of_its_frequency():
    for hz, band in ((100, 7), (1000, 17), (3150, 22)):
        place, db = kernels.band_spectrum(sine(hz, 4), RATE)
        assert place[db.argmax()] == band
        low, high = kernels.BANDS[band] / kernels.SIXTH, kernels.BANDS[band] * kernels.SIXTH
        bins = ((np.fft.rfftfreq(4096, 1 / RATE) >= low) & (np.fft.rfftfreq(4096, 1 / RATE) < high)).sum()
        assert abs(db.max() - 10 * math.log10(0.125 / (bins * RATE / 4096))) < 0.3  # power over the band's width


def test_spectra_of_all_signals_equal_a_plain_transform(spark):
    got = {(r["vec_id"], r["band"]): (r["db"], r["relative_db"]) for r in catalogue.queries()["spectrum_kernel"](spark, SF001).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect():
        x = np.array(r["embedding"], float)
        x = np.concatenate([x, np.zeros(4096 - len(x))])
        window = np.array([0.5 - 0.5 * math.cos(2 * math.pi * k / 4096) for k in range(4096)])
        power = np.abs(np.fft.fft((x - x.mean()) * window)[:2049]) ** 2 / (RATE * (window**2).sum())
        power[1:-1] *= 2
        levels = {}
        for k, p in enumerate(power):
            hz = k * RATE / 4096
            band = next((b for b, centre in enumerate(kernels.BANDS) if centre / kernels.SIXTH <= hz < centre * kernels.SIXTH), None)
            if band is not None:
                levels.setdefault(band, []).append(max(p, 1e-12))
        db = {b: 10 * math.log10(np.mean(v)) for b, v in levels.items()}
        loud = [v for v in db.values() if v > -119]
        want |= {(r["vec_id"], b): (v, v - (np.mean(loud) if loud else -120)) for b, v in db.items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][i] - want[k][i]) < 0.002 for k in want for i in (0, 1))


def test_compressed_signals_of_a_table(spark):
    rows = catalogue.queries()["compress_kernel"](spark, SF001).collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()}
    assert len(rows) == len(x)
    for r in rows:
        y = kernels.compress(x[r["vec_id"]], 1600)
        assert abs(r["rms"] - math.sqrt((y**2).mean())) < 1e-5


def test_signals_of_several_chunks_are_gathered_in_order(spark):
    chunks = spark.createDataFrame([(s, k, RATE, [float(100 * s + 10 * k + i) for i in range(3)]) for s in range(3) for k in (2, 0, 1)], "song int, chunk int, rate int, samples array<double>")
    out = kernels.per_signal(chunks.repartition(3), ["song"], lambda x, rate: np.cumsum(x)).collect()
    for r in out:
        assert np.allclose(r["samples"], np.cumsum([100 * r["song"] + 10 * k + i for k in range(3) for i in range(3)]))


def test_interpolation_between_centres():
    assert kernels.spread(np.array([1.0, 3.0]), np.array([2, 6]), 9).tolist() == [1, 1, 1, 1.5, 2, 2.5, 3, 3, 3]


