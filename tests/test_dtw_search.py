"""Nearest windows under lower bounds against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import warping
from tidemark.operators import dtw_search


def walks(n, length, channels, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, length, channels)).cumsum(axis=1)


def brute(x, labels, queries, k, band):
    out = []
    for q in queries:
        own = [i for i in range(len(x)) if labels[i] == labels[q] and i != q and x[i].shape == x[q].shape]
        if own:
            d = warping.dtw_distances(np.stack([x[q]] * len(own)), np.stack([x[i] for i in own]), "symmetric", band)
            out += [(q, r, i, round(float(v), 9)) for r, (v, i) in enumerate(sorted(zip(d, own, strict=True))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("channels,band", [(1, 3), (2, 2), (1, 0)])
def test_equals_all_distances_and_solves_fewer(spark, channels, band):
    x = walks(160, 30, channels, 1)
    labels = [i % 2 if i < 150 else 7 + i for i in range(160)]  # two classes, and windows alone in theirs
    cols = [f"c{c}" for c in range(channels)]
    rows = [(i, *[x[i, :, c].tolist() for c in range(channels)], labels[i]) for i in range(160)]
    df = spark.createDataFrame(rows, "window_id long, " + ", ".join(f"{c} array<double>" for c in cols) + ", label int")
    solved: list = []
    got = dtw_search.nearest(df, F.col("window_id") % 20 == 0, 3, band, cols, block=16, solved=solved)
    queries = [i for i in range(160) if i % 20 == 0]
    found = sorted((r.window_id, r.rank, r.near_id, round(r.distance, 9)) for r in got.collect())
    assert found == brute(list(x), labels, queries, 3, band)
    if band:
        pairs = sum(labels[i] == labels[q] and i != q for q in queries for i in range(160))
        assert sum(s.count() for s in solved) < 0.7 * pairs


def test_ties_few_mates_and_other_lengths(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 2.0, 3.0], 1), (4, [5.0], 2), (5, [6.0], 2)]
    df = spark.createDataFrame(rows, "window_id long, x array<double>, label int")
    got = dtw_search.nearest(df, F.col("window_id").isin(0, 3, 4), 2, 1)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (4, 1, 5, 1.0)]
    assert dtw_search.nearest(df.limit(0), F.lit(True), 2, 1).count() == 0


def test_pairs_are_solved_where_their_block_lies(spark):
    x = walks(60, 10, 1, 2)
    df = spark.createDataFrame([(i, x[i, :, 0].tolist(), 1) for i in range(60)], "window_id long, x array<double>, label int")
    solved: list = []
    got = dtw_search.nearest(df, F.col("window_id") % 10 == 0, 3, 2, block=16, solved=solved)
    for frame in [got, *solved]:
        assert "RepartitionByExpression [window_id#" not in (plan := frame._jdf.queryExecution().toString()) and "near_id" not in "".join(
            line for line in plan.splitlines() if "hashpartitioning" in line
        )
    assert sorted((r.window_id, r.rank, r.near_id, round(r.distance, 9)) for r in got.collect()) == brute(list(x), [1] * 60, range(0, 60, 10), 3, 2)
