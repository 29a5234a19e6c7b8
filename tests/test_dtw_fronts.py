"""Warping distances by fronts against whole tables, missing points against SQL, and the groups in which queries meet windows."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.functions import warping
from tidemark.operators import dtw_search
from tidemark.plans.catalog import ORACLES, QUERIES

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("n,band", [(64, 7), (64, 0), (64, 1), (64, 6), (30, 40), (5, 9), (3, 0), (2, 1), (1, 3)])
@pytest.mark.parametrize("channels", [1, 3])
def test_fronts_equal_tables(n, band, channels):
    x, y = np.random.default_rng(n + band).normal(size=(2, 50, n, channels))
    a, b = (np.ascontiguousarray(v.transpose(1, 2, 0)) for v in (x[:, ::-1], y))
    assert np.allclose(warping.front_distances(a, b, band), warping.dtw_distances(x, y, "symmetric", band), rtol=1e-12, atol=0)


def test_bounds_lie_below_distances():
    x, y = np.random.default_rng(5).normal(size=(2, 40, 20, 2)).cumsum(axis=2)
    a, b = (np.ascontiguousarray(v.transpose(1, 2, 0)) for v in (x, y))
    bound = dtw_search.bounds(a, b, 3)
    for i in range(40):
        assert (bound[i] <= warping.dtw_distances(np.stack([x[i]] * 40), y, "symmetric", 3) + 1e-9).all()
    assert (bound > 0).any()


def test_missing_points_ties_and_nulls_as_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    plain = lambda: rng.normal(size=64).tolist()

    def odd(at, value):
        x = plain()
        x[at] = value
        return x

    same = plain()
    rows = [(50 * i, plain(), 1) for i in range(20)] + [(None, plain(), 1)]
    rows += [(2000, plain(), 2), (2001, odd(5, None), 2), (2002, odd(10, NAN), 2), (2003, odd(63, None), 2), (2004, odd(63, NAN), 2)]
    rows += [(2100, odd(7, None), 3), (2101, plain(), 3), (2102, plain(), 3), (2103, plain(), 3), (2104, plain(), 3)]
    rows += [(2200, odd(63, NAN), 4), (2201, plain(), 4), (2202, plain(), 4), (2203, odd(63, None), 4)]
    rows += [(2300, odd(20, INF), 5), (2301, odd(20, INF), 5), (2302, odd(63, INF), 5), (2303, plain(), 5), (2304, odd(20, -INF), 5)]
    rows += [(2400, odd(63, INF), 6), (2401, odd(63, INF), 6), (2402, odd(63, -INF), 6), (2403, plain(), 6)]
    rows += [(i, same, 7) for i in (2500, 2505, 2501, 2504, 2503)]
    rows += [(2600, plain(), 8), (2700, plain(), None), (2701, plain(), None)]
    rows += [(i, plain(), 9) for i in (2800, 2800, 2801, 2801, 2802)]
    ids, points, labels = zip(*rows, strict=True)
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(points, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    comparable = lambda found: sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in found), key=str)
    got = comparable(QUERIES["dtw_nearest"](spark, str(tmp_path)).collect())
    assert got == comparable(con.sql(ORACLES["dtw_nearest"]).fetchall())
    assert {r[3] for r in got} >= {INF, "nan", None, 0.0}


def test_queries_meet_windows_in_groups_of_bounded_size(spark, tmp_path, monkeypatch):
    """Noise, where bounds tell nothing: windows and not pairs reach the workers, and every query meets every window of its class once."""
    n, whole = 300, dtw_search.search

    def noted(queries, others, own, k, band):
        np.save(tmp_path / f"{np.random.default_rng().integers(1 << 62)}.npy", own.shape)
        return whole(queries, others, own, k, band)

    monkeypatch.setattr(dtw_search, "search", noted)
    x = np.random.default_rng(4).normal(size=(n, 12))
    df = spark.createDataFrame([(i, x[i].tolist(), i % 3 // 2) for i in range(n)], "window_id long, x array<double>, label int")
    got = dtw_search.nearest(df, F.col("window_id") % 2 == 0, 3, 4, block=16).collect()
    shapes = np.array([np.load(f) for f in tmp_path.glob("*.npy")])
    assert shapes.max() <= 3 * 16
    sizes = [(sum(i % 2 == 0 and i % 3 // 2 == c for i in range(n)), sum(i % 3 // 2 == c for i in range(n))) for c in (0, 1)]
    assert shapes.prod(axis=1).sum() == sum(q * m for q, m in sizes)
    for q in (0, 2, 150, 298):
        own = [i for i in range(n) if i % 3 // 2 == q % 3 // 2 and i != q]
        d = warping.dtw_distances(np.stack([x[q]] * len(own))[..., None], x[own][..., None], "symmetric", 4)
        want = [(r, i, round(float(v), 9)) for r, (v, i) in enumerate(sorted(zip(d, own, strict=True))[:3], 1)]
        assert sorted((r.rank, r.near_id, round(r.distance, 9)) for r in got if r.window_id == q) == want
