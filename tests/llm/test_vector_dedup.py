"""Links, components and bounds of near-duplicate vectors against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import vector_dedup
from tidemark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, tile string, id string, _v int"


def brute(rows, threshold=0.98):
    """vec_id -> (n_links, component_id) of rows with distinct ids."""
    good = [(i, np.array(e, float), lab) for i, e, lab in rows if e and lab is not None and None not in e and np.isfinite(np.array(e, float)).all() and any(e)]
    out = {i: [0, i] for i, _, _ in rows}
    edges = []
    for a, (i, x, k) in enumerate(good):
        for j, y, m in good[:a]:
            if k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                edges.append((i, j))
                out[i][0] += 1
                out[j][0] += 1
    for _ in rows:
        for i, j in edges:
            out[i][1] = out[j][1] = min(out[i][1], out[j][1])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("tile", [3, 1024])
def test_against_brute_force(spark, tile):
    rng = np.random.default_rng(5)
    rows = []
    for group in range(6):
        base = rng.normal(size=16)
        for k in range(12):
            v = base * rng.uniform(0.5, 3) + rng.normal(size=16) * 0.17 * (k % 4)
            rows.append((len(rows), [float(np.float32(x)) for x in v], group % 2))
    rows += [(100 + k, rows[0][1], 0) for k in range(5)]  # equal vectors
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 16, 0), (203, [float("nan")] * 16, 0), (204, [None] * 16, 0), (205, rows[0][1], None)]
    rows += [(206, [float("inf")] * 16, 0), (207, rows[0][1][:8], 0), (208, [3e38] * 16, 1), (209, [3e38] * 16, 1), (210, [1e-38] * 16, 1)]
    df = spark.createDataFrame([(*r, "t", "i", 1) for r in rows], SCHEMA)
    out = vector_dedup.link_vectors(df, tile=tile)
    assert out.columns == [*df.columns, "n_links", "component_id", "kept"]
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    assert got == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.collect())


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(200, 64)), rng.normal(size=(150, 64))
    y[:100] = x[:100] + rng.normal(size=(100, 64)) * 0.15
    (q, s, t, e), (p, u, v, f) = vector_dedup.quantise(x), vector_dedup.quantise(y)
    near = (q.astype(float) @ p.astype(float).T) * s[:, None] * u
    exact = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    bound = t[:, None] * f + e[:, None] * v + e[:, None] * f
    assert (np.abs(near - exact) <= bound + 1e-12).all()
    i, j = vector_dedup.possible_pairs((q, s, t, e), (p, u, v, f), 0.98)
    assert set(zip(*np.nonzero(exact >= 0.98), strict=True)) <= set(zip(i, j, strict=True)) and len(i) < 200


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.link_vectors(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True)]
    assert vector_dedup.link_vectors(df.limit(0)).count() == 0


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op3_vector_dedup"](spark, path).collect()} == brute(rows)
    assert QUERIES["op3_vector_dedup"](spark, path).where(F.col("kept") != (F.col("vec_id") == F.col("component_id"))).count() == 0
