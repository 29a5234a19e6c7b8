"""Warping and augmentation against small direct implementations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import warping
from tidemark.operators import augment, dtw, mates


def slow_table(cost, steps, window):
    p, s = cost.shape
    w = s if window is None else window
    d = np.full((p + 1, s + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, p + 1):
        for j in range(1, s + 1):
            if steps == "asymmetric" and j == 1:
                allowed = i <= w + 1
            else:
                allowed = i - w <= j <= i + w
            if allowed:
                if steps == "symmetric":
                    best = min(d[i - 1, j - 1], d[i, j - 1], d[i - 1, j])
                else:
                    best = min(d[i - 1, j], d[i - 1, j - 1], d[i - 1, j - 2] if j >= 2 else np.inf)
                d[i, j] = cost[i - 1, j - 1] + best
    return d


@pytest.mark.parametrize("steps", ["symmetric", "asymmetric"])
@pytest.mark.parametrize("window", [None, 3])
def test_tables_and_paths(steps, window):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(6, 12, 2)), rng.normal(size=(6, 11, 2))
    tables = warping.cumulate(warping.pair_cost(a, b, window, False), steps, window)
    for n in range(6):
        cost = np.sqrt(((a[n][:, None] - b[n][None]) ** 2).sum(-1))
        w = 11 if window is None else window
        i, j = np.indices(cost.shape)
        cost = np.where((j >= i - w) & (j <= i + w), cost, np.inf)
        assert np.allclose(tables[n], slow_table(cost, steps, window))
    for (i, j), t in zip(warping.dtw_paths(a, b, steps, window), tables):
        if np.isfinite(t[-1, -1]) and steps == "symmetric":
            assert (i[0], j[0], i[-1], j[-1]) == (0, 0, 11, 10)
            assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
    i, j = warping.dtw_paths(a[:1], b[:1], "symmetric", None)[0]
    along = np.sqrt(((a[0][i] - b[0][j]) ** 2).sum(-1)).sum()
    assert along == pytest.approx(warping.dtw_distances(a[:1], b[:1], "symmetric", None)[0])


def test_self_distance_and_symmetry():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(4, 20, 1)), rng.normal(size=(4, 20, 1))
    for shape in (False, True):
        assert np.allclose(warping.dtw_distances(a, a, "symmetric", 4, shape), 0)
        assert np.allclose(warping.dtw_distances(a, b, "symmetric", 4, shape), warping.dtw_distances(b, a, "symmetric", 4, shape)) or shape


@pytest.mark.parametrize("warp,window,weight", [(1, None, 1.0), (1, 1, 1.0), (2, None, 1.3), (1, 3, 1.2)])
def test_weighted_form(warp, window, weight):
    x = np.array([0, 0, 1, 1, 2, 4, 2, 1, 2, 0], float)
    y = np.array([1, 1, 1, 2, 2, 2, 2, 3, 2, 0], float)
    r = c = 10
    cost = np.abs(x[:, None] - y[None])
    full = np.full((r + 1, c + 1), np.inf)
    full[0, 0] = 0
    for i in range(r):
        for j in range(c):
            if window is None or abs(i - j) <= window:
                full[i + 1, j + 1] = cost[i, j]
    for i in range(r):
        for j in range(c):
            if window is not None and abs(i - j) > window:
                continue
            options = [full[i, j]]
            for k in range(1, warp + 1):
                options += [full[min(i + k, r), j] * weight, full[i, min(j + k, c)] * weight]
            full[i + 1, j + 1] = cost[i, j] + min(options)
    got = warping.weighted_dtw(x[None, :, None], y[None, :, None], "cityblock", warp, window, weight)[0]
    assert np.allclose(got, full)


@pytest.fixture(scope="module")
def shapes(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=40).tolist(), rng.normal(size=40).tolist(), 0 if i < 14 else (1 if i < 19 else 2)) for i in range(20)]
    return spark.createDataFrame(rows, "window_id long, a array<double>, b array<double>, label int").cache()


COLS = ("a", "b")


def table(df):
    return df.toPandas().sort_values("window_id").set_index("window_id")


def matrix(row):
    return np.stack([row.a, row.b], axis=1)


def test_mates(shapes):
    got = mates.with_mates(shapes, 3, cols=COLS).toPandas()
    labels = table(shapes)["label"]
    for wid, part in got.groupby("window_id"):
        ids = part["mate_id"].dropna().astype(int).tolist()
        assert len(set(ids)) == len(ids) == min(3, (labels == labels[wid]).sum() - 1)
        assert wid not in ids and all(labels[m] == labels[wid] for m in ids)
    others = mates.with_mates(shapes, 4, cols=COLS, other_class=True).toPandas()
    for wid, part in others.groupby("window_id"):
        ids = part["mate_id"].astype(int).tolist()
        assert len(set(ids)) == 4 and all(labels[m] != labels[wid] for m in ids)


def test_distances_of_pairs(shapes):
    pairs = mates.with_mates(shapes, 2, cols=COLS)
    got = dtw.dtw_path(dtw.dtw_distance(pairs, COLS, ("mate_a", "mate_b"), "symmetric", 5), COLS, ("mate_a", "mate_b"), "symmetric", 5).toPandas()
    for row in got.itertuples():
        if row.mate_id is None or np.isnan(row.mate_id):
            assert row.path is None
            continue
        x, y = matrix(row), np.stack([row.mate_a, row.mate_b], axis=1)
        cost = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
        i, j = np.indices(cost.shape)
        want = slow_table(np.where(abs(i - j) <= 5, cost, np.inf), "symmetric", 5)[-1, -1]
        assert row.distance == pytest.approx(want)
        assert sum(cost[p["i"], p["j"]] for p in row.path) == pytest.approx(want)


def test_spline_reproduces_cubics():
    basis = augment.spline_basis(50, 6)
    at, grid = np.linspace(0, 49, 6), np.arange(50)
    for poly in ([1.0], [1, 0, 0, 0], [0.01, -0.2, 1, 3]):
        assert np.allclose(basis @ np.polyval(poly, at), np.polyval(poly, grid))


def test_magnitudes(shapes):
    base = table(shapes)
    scaled = table(augment.scaling(shapes, COLS))
    ratio = np.stack([np.array(s) / np.array(o) for s, o in zip(scaled["a"], base["a"])])
    assert np.allclose(ratio, ratio[:, :1])
    noise = np.stack([np.array(s) - np.array(o) for s, o in zip(table(augment.jitter(shapes, COLS))["a"], base["a"])])
    assert abs(noise.mean()) < 0.005 and noise.std() == pytest.approx(0.03, rel=0.15)
    flipped = table(augment.rotation(shapes, COLS))
    for i in base.index:
        for c in COLS:
            assert any(np.allclose(np.abs(flipped.loc[i, c]), np.abs(base.loc[i, s])) for s in COLS)
    warped = table(augment.magnitude_warp(shapes, 40, COLS, sigma=0.0))
    assert np.allclose(np.stack(warped["a"]), np.stack(base["a"]))
    moved = table(augment.scale_shift_jitter(shapes, COLS))
    rest = [np.array(s) - np.polyval(np.polyfit(o, s, 1), o) for s, o in zip(moved["a"], base["a"])]
    assert np.std(rest) == pytest.approx(0.5, rel=0.15)  # a line per window, and noise of its own at every point


@pytest.mark.parametrize("mode", ["equal", "random"])
def test_permutation_keeps_values_and_pieces(shapes, mode):
    base, got = table(shapes), table(augment.permutation(shapes, COLS, mode=mode, seed=3))
    changed = 0
    for i in base.index:
        a, b = np.array(base.loc[i, "a"]), np.array(got.loc[i, "a"])
        assert np.allclose(np.sort(a), np.sort(b))
        where = [int(np.flatnonzero(a == v)[0]) for v in b]
        assert np.count_nonzero(np.diff(where) != 1) <= 3
        assert np.array_equal(np.array(base.loc[i, "b"])[where], got.loc[i, "b"])
        changed += where != list(range(40))
    assert changed > 3


def test_slice_and_warp_match_interpolation(shapes):
    base = table(shapes)
    sliced, warped = table(augment.window_slice(shapes, COLS)), table(augment.window_warp(shapes, COLS))
    target, size, n = 36, 4, 40
    for i in base.index:
        x = np.array(base.loc[i, "a"])
        options = [np.interp(np.linspace(0, target, n), np.arange(target), x[s : s + target]) for s in range(n - target)]
        assert any(np.allclose(o, sliced.loc[i, "a"]) for o in options)
        options = []
        for s in range(1, n - size - 1):
            for scale in (0.5, 2.0):
                mid = np.interp(np.linspace(0, size - 1, int(size * scale)), np.arange(size), x[s : s + size])
                whole = np.concatenate([x[:s], mid, x[s + size :]])
                options.append(np.interp(np.arange(n), np.linspace(0, n - 1.0, len(whole)), whole))
        assert any(np.allclose(o, warped.loc[i, "a"]) for o in options)


def test_time_warp(shapes):
    base, got = table(shapes), table(augment.time_warp(shapes, 40, COLS))
    assert np.allclose(np.stack(table(augment.time_warp(shapes, 40, COLS, sigma=0.0))["b"]), np.stack(base["b"]))
    for i in base.index:
        assert min(base.loc[i, "a"]) - 1e-9 <= min(got.loc[i, "a"]) and max(got.loc[i, "a"]) <= max(base.loc[i, "a"]) + 1e-9


def test_guided_warp_follows_the_path_to_the_mate(shapes):
    base, got = table(shapes), table(augment.random_guided_warp(shapes, 40, COLS))
    pairs = mates.with_mates(shapes, 1, cols=COLS).toPandas().set_index("window_id")
    for i in base.index:
        x = matrix(base.loc[i])
        if pd.isna(pairs.loc[i, "mate_id"]):
            want = x
        else:
            y = np.stack([pairs.loc[i, "mate_a"], pairs.loc[i, "mate_b"]], axis=1)
            _, j = warping.dtw_paths(y[None], x[None], "symmetric", 4)[0]
            want = np.stack([np.interp(np.arange(40), np.linspace(0, 39, len(j)), x[j][:, c]) for c in range(2)], axis=1)
        assert np.allclose(matrix(got.loc[i]), want)


def test_barycenter(shapes):
    got = table(augment.barycenter(shapes, 40, COLS, 4))
    drawn = mates.with_mates(shapes, 4, cols=COLS, include_self=True).toPandas().sort_values("mate_no")
    for i, part in drawn.groupby("window_id"):
        s = [np.stack([r.mate_a, r.mate_b], axis=1) for r in part.itertuples()]
        d = np.array([[0 if p is q else warping.dtw_distances(p[None], q[None], "symmetric", 4)[0] for q in s] for p in s])
        mid = int(d.sum(1).argmin())
        order = np.argsort(d[mid], kind="stable")
        total, weight = np.zeros((40, 2)), np.zeros(40)
        for o in order:
            if o == mid:
                total += s[mid]
                weight += 1
                continue
            w = 0.5 ** (d[mid, o] / d[mid, order[1]])
            pi, pj = warping.dtw_paths(s[mid][None], s[o][None], "symmetric", 4)[0]
            total[pi] += w * s[o][pj]
            weight[pi] += w
        assert np.allclose(matrix(got.loc[i]), total / weight[:, None])


def test_spawner_and_discriminative_shapes(shapes):
    base = table(shapes)
    spawned = table(augment.spawner(shapes, 40, COLS, sigma=0.0))
    assert np.allclose(matrix(spawned.loc[19]), matrix(base.loc[19]))  # alone in its class
    for i in base.index:
        assert len(spawned.loc[i, "a"]) == 40
        if i < 19:
            assert not np.allclose(spawned.loc[i, "a"], base.loc[i, "a"])
    plain = table(augment.discriminative_warp(shapes, 40, COLS, variable_slice=False))
    assert np.allclose(matrix(plain.loc[19]), matrix(base.loc[19]))
    sliced = table(augment.discriminative_warp(shapes, 40, COLS))
    assert len(sliced) == 20 and all(len(v) == 40 for v in sliced["b"])


def test_same_rows_on_any_partitioning(shapes):
    for step in ("jitter", "permutation", "windowslice", "spawner", "dgw"):
        one = table(augment.augment(shapes.coalesce(1), [step], 40, COLS, seed=5))
        many = table(augment.augment(shapes.repartition(7, F.col("a")[0]), [step], 40, COLS, seed=5))
        assert np.array_equal(np.stack(one["a"]), np.stack(many["a"])), step


def test_chain_order_tags_and_rounds(shapes):
    out = augment.augment_rounds(shapes, ["scaling", "jitter"], 40, 2, COLS, extra_tag="t").toPandas()
    assert len(out) == 60 and sorted(out["round"].unique()) == [0, 1, 2]
    assert set(out[out["round"] > 0]["tags"]) == {"2_jitter_scaling_t"}
    assert not np.allclose(np.stack(out[out["round"] == 1]["a"]), np.stack(out[out["round"] == 2]["a"]))
    with pytest.raises(ValueError):
        augment.augment(shapes, ["unknown"], 40)


def test_medoid(shapes):
    rows = mates.gather_mates(mates.with_mates(shapes, 5, cols=COLS, include_self=True), "window_id", COLS, ["label"])
    got = dtw.medoid(rows, window=4).toPandas()
    for row in got.itertuples():
        s = [np.stack([np.asarray(c) for c in w]).T for w in row.mates]
        d = np.array([[0 if p is q else warping.dtw_distances(p[None], q[None], "symmetric", 4)[0] for q in s] for p in s])
        assert row.medoid["medoid"] == int(d.sum(1).argmin())
        assert np.allclose(row.medoid["distances"], np.sort(d[row.medoid["medoid"]]))


def test_rounds_are_one_scan(spark, tmp_path):
    df = spark.range(30).select(F.col("id").alias("window_id"), F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: (i * F.col("id")).cast("double")).alias("x"), (F.col("id") % 3).alias("label"))
    df.write.parquet(str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w"))
    scans = {n: augment.augment_rounds(stored, ["jitter", "permutation", "timewarp"], 12, n)._jdf.queryExecution().executedPlan().toString().count("FileScan") for n in (1, 5)}
    assert scans == {1: 1, 5: 1}
    out = augment.augment_rounds(stored, ["jitter", "rgw"], 12, 3)
    rows = out.collect()
    assert len(rows) == 120 and {r.label for r in rows} == {0, 1, 2}
    first = {(r.window_id, r["round"]): list(r.x) for r in rows}
    assert all(first[w, 0] == [float(i * w) for i in range(1, 13)] for w in range(30))
    assert first[4, 1] != first[4, 2] and first[4, 2] != first[4, 3]
    again = {(r.window_id, r["round"]): list(r.x) for r in augment.augment_rounds(stored.repartition(5), ["jitter", "rgw"], 12, 3).collect()}
    assert again == first


def test_windows_without_a_mate_are_no_hot_task(spark):
    df = spark.range(2_000).select(F.col("id").alias("window_id"), F.array(F.lit(1.0)).alias("x"), F.col("id").alias("label"))
    out = mates.with_mates(df, 1)
    spread = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert out.count() == 2_000 and out.where("mate_id IS NOT NULL").count() == 0
    assert spread < 1_200
