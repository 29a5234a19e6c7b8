"""Fitted parts against numpy, model plug-ins, imputation and transforms."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import decompose, forecast, impute, learned, models, scaling, scoring, spectral, stationarity, windows

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(3):
        x = np.cumsum(rng.normal(size=160)) * (s != 2) + 3 * np.sin(np.arange(160) / 3) + rng.normal(size=160)
        rows += [(s, i, float(v), float(v * 0.5 + rng.normal())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id int, idx long, x double, y double").cache()


def arrays(series, col="x"):
    pdf = series.toPandas().sort_values(["series_id", "idx"])
    return {s: p[col].to_numpy() for s, p in pdf.groupby("series_id")}


@pytest.mark.parametrize("kernel", [None, 5])
def test_linear_fit_is_the_ridge_solution(series, kernel):
    wins = windows.forecast_windows(series, 12, 0, 4)
    model = forecast.fit_linear(wins, 12, 4, kernel, ridge=0.1)
    a, b = [], []
    for x in arrays(series).values():
        for i in range(160 - 16 + 1):
            w = x[i : i + 12]
            pad = np.concatenate([[w[0]] * 2, w, [w[-1]] * 2])
            trend = np.convolve(pad, np.ones(5) / 5, mode="valid")
            a.append(np.concatenate([w, [1]] if kernel is None else [w - trend, trend, [1]]))
            b.append(x[i + 12 : i + 16])
    a, b = np.array(a), np.array(b)
    d = a.shape[1]
    gram = a.T @ a
    penalty = 0.1 * np.eye(d)
    penalty[-1, -1] = 0
    want = np.linalg.solve(gram + penalty + 1e-9 * np.trace(gram) / d * np.eye(d), a.T @ b)
    assert np.allclose(model.weights, want, atol=1e-6)
    out = forecast.linear_forecast(windows.sliding_windows(series, 12, 50), model).toPandas()
    assert np.stack(out["pred"]).shape == (9, 4)


@pytest.mark.parametrize("multi", [False, True])
@pytest.mark.parametrize("steps", [3, 30])
def test_linear_dynamics(series, multi, steps):
    wins = windows.sliding_windows(series, 20, 35, ["x", "y"])
    got = forecast.linear_dynamics(wins, ["x", "y"], steps, multi).toPandas()
    for row in got.itertuples():
        z = np.stack([row.x, row.y], axis=1)
        k = np.linalg.pinv(z[:-1]) @ z[1:]
        rec = np.vstack([z[:1], z[:-1] @ k])
        if not multi:
            pred = np.vstack([z[-1:] @ np.linalg.matrix_power(k, h) for h in range(1, steps + 1)])
        elif steps <= 20:
            pred = z[-steps:] @ np.linalg.matrix_power(k, steps)
        else:
            p = np.linalg.matrix_power(k, 20)
            pred = np.vstack([z @ p, z @ p @ p])[:steps]
        assert np.allclose(np.stack(row.dynamics["rec"]).T, rec)
        assert np.allclose(np.stack(row.dynamics["pred"]).T, pred)


def test_low_rank_and_mixture(series):
    wins = windows.sliding_windows(series, 8, 2)
    model, centre = learned.fit_low_rank(wins, 3, 8)
    out = learned.low_rank_reconstruction(wins, model, centre).toPandas()
    m = np.stack(out["x"])
    gap = m - m.mean(0)
    v = np.linalg.svd(gap, full_matrices=False)[2][:3]
    assert np.allclose(np.stack(out["reconstructed"]), gap @ v.T @ v + m.mean(0), atol=1e-6)
    gmm = learned.fit_mixture(wins, 2, seed=1)
    scored = learned.mixture_score(wins, gmm).toPandas()
    x = np.stack(scored["x"])
    dens = np.zeros(len(x))
    for w, g in zip(gmm.weights, gmm.gaussians):
        cov, mu = g.cov.toArray(), g.mean.toArray()
        q = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
        dens += w * np.exp(-0.5 * q) / np.sqrt(np.linalg.det(2 * np.pi * cov))
    assert np.allclose(scored["score"], -np.log(dens), atol=1e-6)


def test_low_rank_of_long_windows(spark):
    rng = np.random.default_rng(3)
    w = rng.normal(size=(60, 3)) * (5, 3, 2) @ rng.normal(size=(3, 2500)) + rng.normal(size=(60, 2500)) * 0.01
    basis, centre = learned.fit_low_rank(spark.createDataFrame([(v.tolist(),) for v in w], "x array<double>"), 3, 2500)
    v = np.linalg.svd(w - w.mean(0), full_matrices=False)[2][:3]
    assert np.allclose(centre, w.mean(0)) and np.allclose(basis @ (basis.T @ v.T), v.T, atol=1e-5)


def test_classifier_separates_shapes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (np.sin(np.arange(16) / (2 + 2 * (i % 3))) + rng.normal(0, 0.05, 16)).tolist(), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "window_id long, x array<double>, label int")
    out = learned.classify(df, learned.fit_classifier(df, balanced=True)).toPandas()
    assert (out["predicted"] == out["label"]).mean() > 0.95
    assert np.allclose(np.stack(out["probabilities"]).sum(1), 1)


@pytest.mark.parametrize("lag", [0, 1, "aic"])
def test_unit_root(series, lag):
    got = stationarity.adf(series, ["x", "y"], lag).toPandas().set_index(["series_id", "feature"])

    def fit(x, p, drop):
        d = np.diff(x)
        y, lvl = d[drop:], x[drop:-1]
        cols = [np.ones(len(y)), lvl] + ([d[drop - 1 : -1]] if p else [])
        a = np.stack(cols, axis=1)
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        rss = ((y - a @ beta) ** 2).sum()
        se = np.sqrt(rss / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
        return beta[1] / se, len(y) * np.log(rss / len(y)) + 2 * a.shape[1]

    for col in ("x", "y"):
        for s, x in arrays(series, col).items():
            p = int(fit(x, 1, 1)[1] < fit(x, 0, 1)[1]) if lag == "aic" else lag
            assert got.loc[(s, col), "lag"] == p
            assert got.loc[(s, col), "stat"] == pytest.approx(fit(x, p, 1 if p else 0)[0])


def test_model_plug_in(spark, series):
    wins = windows.sliding_windows(series, 10, 10, ["x", "y"])
    out = models.score_windows(wins, lambda: lambda w: w[:, -3:, :], "forecast", ["x", "y"]).toPandas()
    ref = wins.toPandas().set_index(["series_id", "w_start"])
    for r in out.itertuples():
        assert np.allclose(r.out[1], ref.loc[(r.series_id, r.w_start), "y"][-3:])
    with pytest.raises(Exception, match="expected 99"):
        models.score_windows(wins, lambda: lambda w: w.mean(axis=(1, 2)), "score", ["x"], length=99).count()

    def broken():
        def run(w):
            raise RuntimeError("no weights")

        return run

    failed = models.score_windows(wins, broken, "score", ["x"], errors="column").toPandas()
    assert failed["out"].isna().all() and failed["error"].str.contains("no weights").all()
    assert scoring.detection_method("USAD") == "reconstruction" and scoring.detection_method("DLinear") == "prediction"


def test_mask_and_impute(series):
    masked = impute.random_mask(series, ["x"], 0.25, seed=9)
    share = masked.agg(F.avg("x_mask")).first()[0]
    assert 0.65 < share < 0.85
    again = impute.random_mask(series.repartition(5), ["x"], 0.25, seed=9)
    assert masked.select("series_id", "idx", "x_mask").exceptAll(again.select("series_id", "idx", "x_mask")).count() == 0
    for method in ("fill", "mean", "trend"):
        out = impute.impute(masked, "x_seen", method, 5)
        pdf = out.toPandas()
        assert pdf["imputed"].notna().all()
        assert (pdf["imputed"] == pdf["x"])[pdf["x_mask"] == 1].all()
    err = impute.imputation_error(impute.impute(masked, "x_seen"), "x", "imputed", F.col("x_mask")).first()
    assert err.cells == masked.where("x_mask = 0").count() and err.mae > 0


def test_constant_and_zero_series_scale_without_nan(spark):
    df = spark.createDataFrame([(0, i, 5.0) for i in range(4)] + [(1, i, 0.0) for i in range(4)], "series_id int, idx long, x double")
    stats = scaling.fit_scaler(df, ["x"])
    for method in ("standard", "standard_eps", "minmax", "minmax_square"):
        assert all(v.x is not None and np.isfinite(v.x) for v in scaling.apply_scaler(df, stats, ["x"], method).collect())
    zero = scaling.apply_scaler(df, stats, ["x"], "minmax_m1p1").where("series_id = 1")
    assert zero.first().x is None  # the maximum is zero: undefined, not infinite


@pytest.mark.parametrize("method", ["standard", "minmax", "minmax_square", "minmax_m1p1"])
def test_scaler_round_trip(series, method):
    positive = series.withColumn("x", F.abs("x") + 1)
    stats = scaling.fit_scaler(positive, ["x"])
    back = scaling.invert_scaler(scaling.apply_scaler(positive, stats, ["x"], method), stats, ["x"], method)
    a, b = arrays(positive), arrays(back)
    assert all(np.allclose(a[s], b[s]) for s in a)


@pytest.mark.parametrize("mode", [m for m in decompose.PAD_MODES if m != "periodization"])
@pytest.mark.parametrize("length", [8, 11])
def test_wavelets_restore_the_window(series, mode, length):
    wins = windows.sliding_windows(series, length, 29)
    out = decompose.inverse_wavelet_window(decompose.wavelet_window(wins, length, 2, mode=mode), 2).toPandas()
    for x, y in zip(out["x"], out["restored"]):
        assert np.allclose(x, y[:length])


def test_longer_wavelet_filter(series):
    root3 = np.sqrt(3)
    low = (np.array([1 - root3, 3 - root3, 3 + root3, 1 + root3]) / (4 * np.sqrt(2))).tolist()
    high = [-low[3], low[2], -low[1], low[0]]
    wins = windows.sliding_windows(series, 16, 40)
    parts = decompose.wavelet_window(wins, 16, 1, low=low, high=high)
    got = parts.toPandas()
    for row in got.itertuples():
        padded = np.concatenate([np.zeros(2), row.x, np.zeros(2)])
        want = [sum(low[::-1][i] * padded[2 * k + i] for i in range(4)) for k in range(9)]
        assert np.allclose(row.low_1, want)
    back = decompose.inverse_wavelet_window(parts, 1, low=low[::-1], high=high[::-1]).toPandas()
    for x, y in zip(back["x"], back["restored"]):
        assert np.allclose(x, y[:16])


def test_harmonics_continue_a_wave(spark):
    t = np.arange(48)
    x = 3 * np.cos(2 * np.pi * 4 * t / 48 + 0.3) + np.sin(2 * np.pi * 9 * t / 48)
    df = spark.createDataFrame([(0, 0, x.tolist())], "series_id int, w_start long, x array<double>")
    got = np.array(spectral.harmonic_extrapolation(df, 48, 12, 2).first().season)
    t = np.arange(60)
    assert np.allclose(got, 3 * np.cos(2 * np.pi * 4 * t / 48 + 0.3) + np.sin(2 * np.pi * 9 * t / 48))


def test_vector_functions_after_array_functions(series):
    """Window scaling, spectra and forecasts chain in one plan."""
    wins = scaling.normalize_window(windows.sliding_windows(series, 16, 16), "x")
    chained = spectral.dft_split(wins, 3)
    assert chained.count() == 30
    assert spectral.delay_aggregation(spectral.autocorrelation(chained)).select(F.size("aggregated")).first()[0] == 16
    assert spectral.select_modes(spectral.spectrum_rows(wins), 16, 3, "random").select("bin").distinct().count() == 3


@settings(max_examples=20, deadline=None)
@given(n=st.integers(1, 80), length=st.integers(1, 20), stride=st.integers(1, 9))
def test_window_count_formula(n, length, stride):
    want = len(range(0, n - length + 1, stride))
    assert want == (max(0, (n - length) // stride + 1) if n >= length else 0)


def test_frequency_strings():
    assert [calendar.frequency_unit(f) for f in ("h", "15min", "D", "W-SUN", "M", "Q", "3S", "Y", "B", "T")] == list("HTDWMQSYBT")
    sizes = {f: len(calendar.BY_FREQUENCY[f]) for f in calendar.BY_FREQUENCY}
    assert sizes == {"Y": 0, "Q": 1, "M": 1, "W": 2, "D": 3, "B": 3, "H": 4, "T": 5, "S": 6}
    with pytest.raises(ValueError):
        calendar.time_features("fortnight")


def test_softmax_and_divergence(spark):
    from tidemark.functions.arrays import softmax

    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.2, 0.8], [0.5, 0.5])], "a array<double>, p array<double>, q array<double>")
    row = df.select(softmax(F.col("a")).alias("s"), scoring.kl_divergence("p", "q").alias("k")).first()
    e = np.exp([1.0, 2.0, 3.0])
    p, q = np.array([0.2, 0.8]) + 1e-4, np.array([0.5, 0.5]) + 1e-4
    assert np.allclose(row.s, e / e.sum()) and row.k == pytest.approx((p * np.log(p / q)).sum())


def test_circular_correlation_definition(spark):
    rng = np.random.default_rng(0)
    q, k = rng.normal(size=7), rng.normal(size=7)
    df = spark.createDataFrame(pd.DataFrame({"q": [q.tolist()], "k": [k.tolist()]}))
    got = df.select(spectral.circular_correlation("q", "k").alias("c")).first().c
    assert np.allclose(got, [sum(q[(i + lag) % 7] * k[i] for i in range(7)) for lag in range(7)])


def test_degenerate_series_give_null_statistics(spark):
    from tidemark.operators import forecast_metrics

    flat = spark.createDataFrame([(0, i, 1.0) for i in range(9)] + [(1, 0, 2.0), (2, 0, 1.0), (2, 1, 3.0)], "series_id int, idx long, x double")
    assert all(r.stat is None for r in stationarity.adf(flat).collect())
    pairs = flat.select("series_id", F.col("x").alias("true"), (F.col("x") + 1).alias("pred"), F.lit(1).alias("h"))
    out = {r.series_id: r for r in forecast_metrics.basic_metrics(pairs, ["series_id"]).collect()}
    assert out[0].mae == 1.0 and out[0].rse is None
    assert forecast_metrics.corr(pairs.where("series_id = 0"), ["h"]).first()["corr"] is None


def test_dynamics_of_near_collinear_features_equal_lstsq(spark):
    from tidemark.operators import forecast

    rng = np.random.default_rng(3)
    rows = []
    for i in range(5):
        a = rng.normal(size=40).cumsum()
        b = a + 1e-6 * rng.normal(size=40)  # condition about 1e6, its square would lose all digits
        rows.append((0, i, a.tolist(), b.tolist(), rng.normal(size=40).tolist()))
    rows.append((0, 9, [1.0] * 10, [2.0] * 10, [0.0] * 10))  # dependent features: the smallest solution
    df = spark.createDataFrame(rows, "series_id int, w_start int, a array<double>, b array<double>, c array<double>")
    for r in forecast.linear_dynamics(df, ["a", "b", "c"], 3).collect():
        z = np.array([r.a, r.b, r.c]).T
        k = np.linalg.lstsq(z[:-1], z[1:], rcond=1e-12)[0]
        # one step: powers of so badly determined a matrix lose their digits in any solver
        assert np.allclose(np.array(r.dynamics.pred)[:, 0], z[-1] @ k, rtol=1e-8, atol=1e-9)
        assert np.allclose(np.array(r.dynamics.rec), np.vstack([z[:1], z[:-1] @ k]).T, rtol=1e-9, atol=1e-9)


def test_scalers_go_back_with_the_numbers_of_the_way_out(spark):
    from tidemark.operators import scaling

    df = spark.createDataFrame([(0, i, 5.0 if i < 9 else 7.0) for i in range(10)], "series_id int, idx int, x double")
    stats = scaling.fit_scaler(df.where("idx < 9"), ["x"])
    there = scaling.apply_scaler(df, stats, ["x"], "standard_eps")
    assert [r.x for r in scaling.invert_scaler(there, stats, ["x"], "standard_eps").orderBy("idx").collect()] == pytest.approx([5.0] * 9 + [7.0])


def test_detectors_of_both_lists_are_known():
    assert all(scoring.detection_method(m) == "reconstruction" for m in ("USAD", "VAE", "VTTPAT", "VTTSAT"))
    assert scoring.detection_method("DLinear") == "prediction"


def test_windows_pass_as_flat_arrow_buffers(spark):
    """Nulls and NaN inside windows, windows of other lengths and missing ones come out as when each was a Python object."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"x": pa.array([[1.0, None], [3.0, 4.0]]), "n": pa.array([[1, 2], [3, 4]])})
    for part, want in ((batch, [[[1, 1], [np.nan, 2]], [[3, 3], [4, 4]]]), (batch.slice(1, 1), [[[3, 3], [4, 4]]])):
        assert np.array_equal(models.arrow_windows(part, ["x", "n"], 2), np.array(want, float), equal_nan=True)
    with pytest.raises(models.ShapeError):
        models.arrow_windows(batch, ["x"], 3)
    with pytest.raises(ValueError):
        models.arrow_windows(pa.RecordBatch.from_pydict({"x": pa.array([[1.0], [3.0, 4.0]])}), ["x"], None)
    assert models.result_lists(np.array([[1, 2], [3, 4]]), False).to_pylist() == [[1.0, 2.0], [3.0, 4.0]]
    assert models.result_lists(np.arange(6.0).reshape(1, 3, 2), True).to_pylist() == [[[0.0, 2.0, 4.0], [1.0, 3.0, 5.0]]]
    assert models.result_lists(np.array([np.nan, 1.0]), False).to_pylist() == [[None], [1.0]]
