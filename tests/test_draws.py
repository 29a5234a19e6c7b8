"""Draws are the same numbers in Spark and in SQL, and look random."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import draws
from tidemark.plans import draws_sql as q


def test_sql_repeats_the_draws(spark):
    df = spark.range(500).withColumn("i", F.col("id") * 3).withColumn("big", F.col("id") * draws.PRIME)
    got = df.select(
        "id", draws.cell(5, "jit", F.col("id"), "x", F.col("i")).alias("c"), draws.normal(5, "jit", F.col("id")).alias("n"),
        draws.integer(1, 7, 5, "k", F.col("id")).alias("k"),
    ).orderBy("id").toPandas()
    own = q.Sql("id")
    sql = f"""SELECT id, {q.cell(5, 'jit', own, 'x', q.Sql('id * 3'))} AS c, {q.normal(5, 'jit', own)} AS n, {q.integer(1, 7, 5, 'k', own)} AS k FROM range(500) t(id) ORDER BY id"""
    want = duckdb.connect().execute(sql).df()
    assert (got.c == want.c).all() and (got.k == want.k).all() and np.allclose(got.n, want.n, rtol=0, atol=1e-12)
    assert df.select(F.count_distinct(draws.cell(1, F.col("big")))).first()[0] == 500


def test_draws_are_even_and_independent(spark):
    out = spark.range(20_000).select(draws.uniform(3, "u", F.col("id")).alias("u"), draws.normal(3, "n", F.col("id"), 4).alias("n"), draws.uniform(4, "u", F.col("id")).alias("v"))
    p = out.toPandas()
    assert abs(p.u.mean() - 0.5) < 0.01 and abs(p.n.std() - 1) < 0.03 and abs(p.n.mean()) < 0.03
    assert abs(np.corrcoef(p.u[:-1], p.u[1:])[0, 1]) < 0.03 and abs(np.corrcoef(p.u, p.v)[0, 1]) < 0.03
    assert np.histogram(p.u, 10)[0].min() > 1_800


def test_keys_of_any_type(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.5), (None, 2.5)], "s string, d double")
    got = [r.c for r in df.select(draws.cell(0, F.col("s"), F.col("d")).alias("c")).collect()]
    assert len(set(got)) == 3 and all(0 <= c < draws.PRIME for c in got)
