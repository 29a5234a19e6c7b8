"""Transforms by array expressions and by rows against numpy, and their plans."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import fourier
from tidemark.operators import spectral


def frame(spark, *arrays):
    return spark.createDataFrame([(0, i, None if a is None else [float(v) for v in a]) for i, a in enumerate(arrays)], "series_id int, w_start int, x array<double>")


ARRAYS = [np.random.default_rng(n).normal(size=n) for n in (1, 2, 3, 7, 8, 24, 25, 61)]


def column(df, col):
    return [r.v for r in df.select("w_start", col.alias("v")).orderBy("w_start").collect()]


def test_transforms_equal_numpy(spark):
    df = frame(spark, *ARRAYS)
    for a, s in zip(ARRAYS, column(df, fourier.rfft("x")), strict=True):
        want = np.fft.rfft(a)
        assert np.allclose(s.re, want.real) and np.allclose(s.im, want.imag)
    bins = [0, 1, 3, 3, 99]
    for a, v in zip(ARRAYS, column(df, fourier.keep_bins("x", F.array(*[F.lit(b) for b in bins]))), strict=True):
        spectrum = np.fft.rfft(a)
        mask = np.isin(np.arange(len(spectrum)), bins)
        assert np.allclose(v, np.fft.irfft(spectrum * mask, n=len(a)))
    for a, v in zip(ARRAYS[3:], column(df, fourier.strongest_part("x", 3))[3:], strict=True):
        spectrum = np.fft.rfft(a)
        strength = np.abs(spectrum)
        strength[0] = 0
        assert np.allclose(v, np.fft.irfft(np.where(strength > np.sort(strength)[-3], spectrum, 0), n=len(a)))


def test_autocorrelation_is_symmetric_to_the_bit(spark):
    df = frame(spark, *ARRAYS)
    for a, v in zip(ARRAYS, column(df, fourier.circular_correlation("x", "x")), strict=True):
        n = len(a)
        assert np.allclose(v, [sum(a[(i + lag) % n] * a[i] for i in range(n)) for lag in range(n)])
        assert all(v[lag] == v[n - lag] for lag in range(1, n))


def test_null_and_empty_arrays(spark):
    df = frame(spark, None, [], [1.0])
    for col in (fourier.rfft("x"), fourier.keep_bins("x", F.array(F.lit(0))), fourier.strongest_part("x", 2), fourier.circular_correlation("x", "x")):
        got = column(df, col)
        assert got[:2] == [None, None] and got[2] is not None


@pytest.mark.parametrize("length", [24, 25])
def test_long_windows_as_rows(spark, monkeypatch, length):
    rng = np.random.default_rng(length)
    df = frame(spark, *rng.normal(size=(3, length)))
    rows = lambda out: sorted((r.w_start, r.feature, r.bin, round(r.amp, 9)) for r in out.collect())
    short = rows(spectral.spectrum_rows(df))
    monkeypatch.setattr(spectral, "LONG", 1)
    assert rows(spectral.spectrum_rows(df, length=length)) == short
    assert len(short) == 3 * (length // 2 + 1)


def test_no_python_in_the_plans(spark):
    df = frame(spark, *ARRAYS[5:6])
    outs = [
        spectral.spectrum_rows(df), spectral.spectrum_split(df, [0, 1]), spectral.dft_split(df, 3), spectral.autocorrelation(df),
        spectral.delay_aggregation(spectral.autocorrelation(df)), spectral.shared_lags(df), spectral.harmonic_extrapolation(df, 24, 4, 2),
    ]
    for out in outs:
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
