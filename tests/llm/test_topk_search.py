"""Exact top-k search against brute force in whole numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tidemark.llm import topk_search

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, k, every):
    """(query_id, rank, vec_id, score) of every row that takes part."""

    def whole(v):
        if v is None or any(x is None or not math.isfinite(x * 1024) for x in v):
            return None
        return [math.floor(x * 1024) for x in v]

    vectors = [(i, r[0], whole(r[1])) for i, r in enumerate(rows)]
    vectors = [v for v in vectors if v[2] is not None]
    out = []
    for i, q, a in vectors:
        if q is None or q % every:
            continue
        score = lambda b: min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(1 << 63)), (1 << 63) - 1)
        met = [(-score(b), p is None, p or 0, p) for j, p, b in vectors if j != i and len(a) == len(b)]
        # equal (score, vec_id) are equal result rows, whatever their order
        for rank, (less, _, _, p) in enumerate(sorted(met, key=lambda m: m[:3])[:k], 1):
            out.append((q, rank, p, -less))
    return sorted(out, key=str)


def found(spark, rows, k=3, every=5, **options):
    got = topk_search.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, every=every, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def random_rows(n, d, seed, spread=1.0):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, spread) for _ in range(d)], "x") for i in range(n)]


@pytest.mark.parametrize("d,lists,spread", [(8, 4, 1.0), (5, 3, 0.01), (1, 4, 1.0), (6, 1, 1000.0)])
def test_equals_brute_force(spark, d, lists, spread):
    rows = random_rows(60, d, d)
    rows = [(i, [x * spread for x in v], s) for i, v, s in rows]
    assert found(spark, rows, lists=lists, strips=3) == brute(rows, 3, 5)


def test_ties_and_repeated_rows(spark):
    rows = [(i % 12, [float(i % 3), 1.0], "x") for i in range(40)] + [(10, [1.0, 1.0], "x")] * 6 + [(None, [2.0, 1.0], "x")] * 2
    assert found(spark, rows) == brute(rows, 3, 5)


def test_few_rows_and_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0], "x"), (5, [0.5, -1.0], "x"), (7, None, "x"), (10, [float("nan"), 1.0], "x"), (15, [None, 1.0], "x"),
        (20, [float("inf"), 0.0], "x"), (25, [], "x"), (26, [], "x"), (30, [1.0, 2.0, 3.0], "x"), (35, [0.0, 0.0], "x"),
    ]
    assert found(spark, rows, k=10) == brute(rows, 10, 5)


def test_large_numbers_are_exact(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([1e5, 1e9, 3e12, -2e14]) * draw.random() for _ in range(4)], "x") for i in range(20)]
    assert found(spark, rows, k=4) == brute(rows, 4, 5)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_phase_two_collects_every_result():
    rng = np.random.default_rng(5)
    q, x = rng.integers(-50, 50, (4, 8)).astype(float), rng.integers(-50, 50, (300, 8)).astype(float)
    local = topk_search.local_scores(q, x, 4)
    own = np.zeros((4, 300), bool)
    total = q @ x.T
    i, j = topk_search.gathered(local, own, 5)
    cutoffs = np.array([int(np.sort(total[n, j[i == n]])[-5]) for n in range(4)], object)
    i, j = topk_search.sufficient(local, own, cutoffs)
    for n in range(4):
        best = set(np.flatnonzero(total[n] >= cutoffs[n]))
        assert best <= set(j[i == n])
        assert len(j[i == n]) < 300
