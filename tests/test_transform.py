"""Transforms of any length against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import signal


def frame(spark, series):
    rows = [(k, i + 1, float(x)) for k, v in series.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "series_id string, seq long, value double")


def spectra(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["series_id"], {})[r["bin"]] = complex(r["real"], r["imag"])
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(3)
    return {f"n{n}": rng.normal(size=n) + 3 for n in (1, 2, 3, 8, 997, 1024, 1025, 2048, 2053, 3000)} | {None: rng.normal(size=1031)}


def test_unpadded(spark, noise):
    df = frame(spark, noise)
    got = spectra(signal.fft(df, pad=False))
    assert got.keys() == noise.keys()
    for k, v in noise.items():
        assert np.allclose(got[k], np.fft.fft(v), atol=1e-8 * len(v))
    back = {}
    for r in signal.ifft(signal.fft(df, pad=False)).collect():
        back.setdefault(r["series_id"], {})[r["seq"]] = r["value"]
    for k, v in noise.items():
        assert np.allclose([back[k][i + 1] for i in range(len(v))], v, atol=1e-9)


@pytest.mark.parametrize("size", [5, 64, 1500])
def test_given_size(spark, noise, size):
    got = spectra(signal.fft(frame(spark, noise), size=size))
    for k, v in noise.items():
        assert np.allclose(got[k], np.fft.fft(v, size), atol=1e-8 * size)


def test_padded(spark, noise):
    got = spectra(signal.fft(frame(spark, noise)))
    for k, v in noise.items():
        assert np.allclose(got[k], np.fft.fft(v, 1 << (len(v) - 1).bit_length()), atol=1e-8 * len(v))


def test_long_prime_in_small_pieces(spark):
    """A prime length of 2^17 - 1: no piece of any step has more than 512 samples."""
    n = 2 ** 17 - 1
    df = spark.range(n).select(F.lit("s").alias("series_id"), (F.col("id") + 1).alias("seq"), ((F.col("id") * 7919) % 1009).cast("double").alias("value"))
    got = {r["bin"]: complex(r["real"], r["imag"]) for r in signal.fft(df, pad=False).collect()}
    want = np.fft.fft((np.arange(n) * 7919) % 1009)
    assert len(got) == n and np.abs(np.array([got[i] for i in range(n)]) - want).max() < 1e-9 * np.abs(want).max()


def test_missing_bins_and_no_rows(spark):
    x = np.random.default_rng(1).normal(size=1500)
    low = signal.spectrum_filter(signal.fft(frame(spark, {"s": x}), pad=False), max_bin=20)
    y = np.fft.fft(x)
    y[21:1480] = 0
    got = [r["value"] for r in signal.ifft(low).orderBy("seq").collect()]
    assert np.allclose(got, np.fft.ifft(y).real, atol=1e-9)
    none = frame(spark, {"s": x}).filter("false")
    assert signal.fft(none, pad=False).count() == signal.ifft(signal.fft(none)).count() == 0
