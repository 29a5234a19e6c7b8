from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning, decompose, ordering, windows


def frame(spark, sizes=(1, 7, 40, 200), seed=0):
    rng = np.random.default_rng(seed)
    rows = [(s, int(t), float(rng.normal())) for s, n in enumerate(sizes) for t in rng.permutation(n * 3)[:n]]
    return spark.createDataFrame(rows, "series_id int, ts long, x double"), pd.DataFrame(rows, columns=["series_id", "ts", "x"])


@pytest.mark.parametrize("chunks", [None, 2, 50])
def test_index_matches_sorted_position(spark, chunks):
    df, pdf = frame(spark)
    got = ordering.add_index(df, chunk=chunks).toPandas().sort_values(["series_id", "ts"])
    want = pdf.sort_values(["series_id", "ts"]).groupby("series_id").cumcount()
    assert got["idx"].tolist() == want.tolist()


def test_index_does_not_depend_on_partitions(spark):
    df, _ = frame(spark)
    one = ordering.add_index(df.coalesce(1)).orderBy("series_id", "idx").collect()
    many = ordering.add_index(df.repartition(8)).orderBy("series_id", "idx").collect()
    assert one == many


def test_running_totals_with_equal_order_in_other_chunks(spark):
    df, pdf = frame(spark, (120,))
    cut = df.withColumn("_chunk", F.floor(F.col("ts") / 17))
    got = ordering.running_totals(cut, [], ["ts"], {"s": F.col("x"), "c": F.lit(1)}).toPandas().sort_values("ts")
    want = pdf.sort_values("ts")["x"].cumsum().to_numpy()
    assert np.allclose(got["s"], want)
    assert got["c"].tolist() == list(range(1, 121))


@pytest.mark.parametrize("width", [3, 10, 1000])
def test_fill_equals_pandas(spark, width):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"series_id": np.repeat([0, 1], 50), "ts": np.tile(np.arange(50), 2), "x": rng.normal(size=100)})
    pdf.loc[rng.random(100) < 0.6, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = cleaning.fill_forward_backward(df, ["x"], chunk=F.floor(F.col("ts") / width)).toPandas().sort_values(["series_id", "ts"])
    want = pdf.groupby("series_id")["x"].transform(lambda s: s.ffill().bfill())
    assert np.allclose(got["x"], want)


@pytest.mark.parametrize("rows", [8, 64])
def test_moving_average_blocks(spark, rows):
    df, pdf = frame(spark, (1, 9, 150))
    indexed = ordering.add_index(df)
    got = decompose.decompose(indexed, 7, rows=rows).toPandas().sort_values(["series_id", "idx"])
    for sid, part in pdf.sort_values(["series_id", "ts"]).groupby("series_id"):
        x = part["x"].to_numpy()
        padded = np.concatenate([np.repeat(x[0], 3), x, np.repeat(x[-1], 3)])
        trend = np.convolve(padded, np.ones(7) / 7, mode="valid")
        mine = got[got.series_id == sid]
        assert np.allclose(mine["trend"], trend)
        assert np.allclose(mine["trend"] + mine["seasonal"], x)


def test_even_kernel_is_rejected(spark):
    df, _ = frame(spark, (9,))
    with pytest.raises(ValueError):
        decompose.decompose(ordering.add_index(df), 4)


@pytest.mark.parametrize("length,stride,rows", [(5, 1, 8), (5, 3, 7), (8, 8, 16), (4, 9, 5)])
def test_windows_of_series_around_the_length(spark, length, stride, rows):
    sizes = (1, length - 1, length, length + 1, 57)
    df, pdf = frame(spark, sizes)
    wins = windows.sliding_windows(ordering.add_index(df), length, stride, rows=rows).toPandas()
    for sid, n in enumerate(sizes):
        x = pdf[pdf.series_id == sid].sort_values("ts")["x"].to_numpy()
        starts = list(range(0, n - length + 1, stride))
        mine = wins[wins.series_id == sid].sort_values("w_start")
        assert mine["w_start"].tolist() == starts
        assert mine["w_no"].tolist() == list(range(len(starts)))
        for start, w in zip(starts, mine["x"]):
            assert np.array_equal(w, x[start : start + length])


def test_no_single_partition_exchange_of_data(spark):
    """One long series: only the table of chunk totals may meet in one task."""
    df = spark.range(5000).select(F.col("id").alias("ts"), F.rand(1).alias("x"))
    out = windows.sliding_windows(ordering.add_index(df, keys=[], chunk=F.floor(F.col("ts") / 100)), 50, 1, keys=[])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1
    assert out.count() == 4951


def test_exponential_smoothing_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=1500)
    df = spark.createDataFrame(pd.DataFrame({"series_id": 0, "idx": np.arange(1500), "x": x}))
    got = decompose.exponential_smoothing(df, 0.6, v0=3.0).toPandas().sort_values("idx")["smoothed"].to_numpy()
    y, want = 3.0, []
    for v in x:
        y = 0.6 * y + 0.4 * v
        want.append(y)
    assert np.allclose(got, want, atol=1e-12)


def test_schema_contract(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0)], "series_id string, ts long, f1 double, f2 double")
    assert cleaning.validate_schema(df, ["f1", "f2"], width=2).columns == ["series_id", "ts", "f1", "f2"]
    assert cleaning.discover_features(df) == ["f1", "f2"]
    for bad in (dict(features=["f3"]), dict(features=["f2", "f1"]), dict(features=["f1"], width=2), dict(features=["series_id"])):
        with pytest.raises(cleaning.SchemaError):
            cleaning.validate_schema(df, **bad)


def test_one_timestamp_with_a_third_of_all_rows(spark):
    rng = np.random.default_rng(8)
    ts = np.where(rng.random(900) < 0.4, 50, rng.integers(0, 100, 900))
    pdf = pd.DataFrame({"series_id": rng.integers(0, 2, 900), "ts": ts, "n": rng.permutation(900)})
    df = spark.createDataFrame(pdf)
    cut = ordering.range_chunk(df, ["ts", "n"], 8)
    largest = cut.groupBy("_chunk").count().agg(F.max("count")).first()[0]
    assert largest < 200
    got = ordering.add_index(df, order=["ts", "n"], chunk=8).toPandas().sort_values(["series_id", "ts", "n"])
    assert got["idx"].tolist() == got.groupby("series_id").cumcount().tolist()


@pytest.mark.parametrize("by", [[], ["g"]])
def test_exact_quantiles(spark, by):
    from tidemark.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "score": np.round(rng.normal(size=400), 1)})
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), probs, by=by, chunks=5).toPandas()
    for row in got.itertuples():
        part = pdf if not by else pdf[pdf.g == row.g]
        assert np.allclose(row.quantiles, np.quantile(part["score"], probs))


def test_rows_without_a_timestamp_stay(spark):
    df = spark.createDataFrame([(0, None, 1), (0, 5, 2), (0, None, 3), (0, 1, 4)], "series_id int, ts long, n int")
    for chunk in (None, F.floor(F.col("ts") / 3)):
        got = ordering.add_index(df, order=["ts", "n"], chunk=chunk).orderBy("idx").collect()
        assert [r.n for r in got] == [1, 3, 4, 2] and [r.idx for r in got] == [0, 1, 2, 3]


@pytest.mark.parametrize("alpha", [0.9, 0.05, 0.9999, 0.999999])
def test_exponential_smoothing_keeps_all_history(spark, alpha):
    n = 3000
    x = np.zeros(n)
    x[0], x[7], x[1500] = 1e60, -3.0, 2.0
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "series_id long, idx long, x double")
    got = decompose.exponential_smoothing(df, alpha, 4.0).toPandas().sort_values("idx")["smoothed"].to_numpy()
    want, state = [], 4.0
    for v in x:
        state = alpha * state + (1 - alpha) * v
        want.append(state)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-300)


def test_nulls_in_averages_and_filters(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0])], "series_id long, idx long, x double")
    ma = decompose.moving_average(df, [3]).toPandas().sort_values("idx")["ma_3"].tolist()
    assert np.allclose(ma, [4 / 3, 1.5, 3.0, 4.5, 5.0, 17 / 3])
    lagged = decompose.causal_filter(df, [1.0, 0.0, 0.0]).toPandas().sort_values("idx")["filtered"].tolist()
    assert lagged == [0, 0, 1, 2, 0, 4]


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_levels_of_prefix_sums(spark, levels):
    n = 20_000
    df = spark.range(n).select(F.lit("s").alias("series_id"), F.col("id").alias("idx"), (F.col("id") % 7).alias("x"))
    out = ordering.running_totals(df.withColumn(ordering.CHUNK, ordering.idx_chunk("idx", 4)), ["series_id"], ["idx"], {"t": F.col("x")}, levels=levels)
    got = np.array([r.t for r in out.orderBy("idx").collect()])
    assert (got == np.cumsum(np.arange(n) % 7)).all()


def test_a_level_scans_few_rows(spark):
    totals = spark.range(25_000).select(F.lit("s").alias("k"), F.col("id").alias("c"), F.lit(1).alias("_sum_t"))
    cut = totals.withColumn("u", F.floor(F.col("c") / ordering.FAN)).withColumn("uu", F.floor(F.col("u") / ordering.FAN))
    for level, below in (("u", "c"), ("uu", "u")):
        most = cut.groupBy("k", level).agg(F.count_distinct(below).alias("n")).agg(F.max("n")).first()[0]
        assert most <= ordering.FAN
    off = ordering.totals_before(totals, ["k"], "c", ["t"], 2)
    assert off.where("_off_t <> c").count() == 0 and off.count() == 25_000


@pytest.mark.parametrize("levels", [0, 2])
def test_fill_across_many_chunks(spark, levels):
    known = {5: 1.0, 4_000: 2.0, 9_999: 3.0}
    df = spark.range(10_000).select(F.lit("s").alias("series_id"), F.col("id").alias("idx"))
    at = F.create_map(*[F.lit(v) for kv in known.items() for v in kv])
    df = df.withColumn("x", at[F.col("idx").cast("int")]).withColumn(ordering.CHUNK, ordering.idx_chunk("idx", 3))
    got = [r.x for r in ordering.fill_nearest(df, ["series_id"], ["idx"], ["x"], levels=levels).orderBy("idx").collect()]
    assert got == [1.0] * 4_000 + [2.0] * 5_999 + [3.0]


def test_empty_and_constant_order(spark):
    df = spark.createDataFrame([("a", 1, 5.0)], "series_id string, ts long, x double")
    assert [r.idx for r in ordering.add_index(df).collect()] == [0]
    assert ordering.add_index(df.limit(0)).count() == 0


def test_short_series_are_numbered_without_a_join(spark):
    df = spark.range(6_000).select((F.col("id") % 300).alias("series_id"), F.col("id").alias("ts"), F.rand(2).alias("x"))
    out = ordering.add_index(df)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where(F.col("idx") != F.floor(F.col("ts") / 300)).count() == 0 and out.count() == 6_000


@pytest.mark.parametrize("rows", [3, 30, 100])
def test_heavy_series_are_cut_and_others_left_whole(spark, monkeypatch, rows):
    monkeypatch.setattr(ordering, "LIGHT_ROWS", rows)
    df, pdf = frame(spark, (1, 7, 40, 200, 0, 60))
    light = F.every(F.col(ordering.CHUNK) == ordering.LIGHT).alias("light")
    cut = ordering.series_chunk(df, ["series_id"], ["ts"]).groupBy("series_id").agg(light).collect()
    limit = max(rows, len(pdf) // (ordering.OVERSPLIT * ordering.shuffle_width(df)))
    sizes = pdf.groupby("series_id").size()
    assert all(r.light == (sizes[r.series_id] <= limit) for r in cut) and len(cut) == 5
    got = ordering.add_index(df).toPandas().sort_values(["series_id", "ts"])
    assert got["idx"].tolist() == pdf.sort_values(["series_id", "ts"]).groupby("series_id").cumcount().tolist()


def test_chunks_of_many_heavy_series_hold_many_rows(spark, monkeypatch):
    """Series of equal size that are all heavy: the table of chunk totals stays far shorter than the data."""
    monkeypatch.setattr(ordering, "LIGHT_ROWS", 10)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(100_000).select((F.col("id") % 200).alias("series_id"), F.col("id").alias("ts"), F.rand(2).alias("x"))
        pieces = ordering.series_chunk(df, ["series_id"], ["ts"]).groupBy("series_id", ordering.CHUNK).count()
        assert pieces.where(F.col(ordering.CHUNK) != ordering.LIGHT).count() == pieces.count() <= 100_000 // 50
        assert ordering.add_index(df).where(F.col("idx") != F.floor(F.col("ts") / 200)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
