from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators import windows
from tidemark.plans import flows
from tidemark.sources import readers, sinks, synthetic

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write(path, text):
    path.write_text(text)
    return str(path)


def test_wide_csv_one_series_per_file(spark, tmp_path):
    write(tmp_path / "one.csv", "date,f1,OT\n2016-07-01 00:00:00,1,2\n2016-07-01 01:00:00,3,4\n")
    write(tmp_path / "two.csv", "date,f1,OT\n2016-07-01 00:00:00,5,6\n")
    df = readers.read_wide_csv(spark, str(tmp_path))
    assert df.columns == ["series_id", "ts", "f1", "OT"]
    assert dict(df.dtypes)["OT"] == "double"
    rows = {(r.series_id, r.ts.hour): (r.f1, r.OT) for r in df.collect()}
    assert rows == {("one", 0): (1.0, 2.0), ("one", 1): (3.0, 4.0), ("two", 0): (5.0, 6.0)}


def test_semicolons_trimmed_names_and_dropped_columns(spark, tmp_path):
    p = write(tmp_path / "s.csv", " datetime; a ;changepoint\n2020-03-09 10:14:33;0.5;1\n")
    df = readers.read_wide_csv(spark, p, sep=";", drop=["changepoint"])
    assert df.columns == ["series_id", "ts", "a"] and df.first().ts.second == 33


def test_stacked_files_fill_missing_columns(spark, tmp_path):
    a, b = write(tmp_path / "a.csv", "x,y\n1,2\n"), write(tmp_path / "b.csv", "x , z\n3,4\n")
    got = [tuple(r) for r in readers.read_stacked_csvs(spark, [a, b]).select("x", "y", "z").orderBy("x").collect()]
    assert got == [(1, 2, None), (3, None, 4)]


def test_labels_stay_aligned_when_rows_have_nulls(spark, tmp_path):
    d = write(tmp_path / "d.csv", "timestamp_(min),f\n0,1.0\n1,\n2,3.0\n3,4.0\n")
    lab = write(tmp_path / "l.csv", "timestamp_(min),label\n0,0\n1,1\n2,1\n3,0\n")
    got = readers.read_labelled(spark, d, lab).orderBy("timestamp_(min)").collect()
    assert [(r["f"], r["label"]) for r in got] == [(1.0, 0), (3.0, 1), (4.0, 0)]
    both = readers.read_train_test(spark, d, lab, d, lab)
    assert both.groupBy("part").count().count() == 2


def test_interval_lists(spark):
    lists = spark.createDataFrame([("a", "[[5, 9], 20]"), ("b", "[[0, 2], [1, 7000]]"), ("c", "[]")], "series_id string, t string")
    got = {tuple(r) for r in readers.parse_intervals(lists, "t").collect()}
    assert got == {("a", 5, 9), ("a", 20, 20), ("b", 0, 2), ("b", 1, 7000)}
    points = spark.range(0, 8000).select(F.explode(F.array(*[F.lit(c) for c in "abc"])).alias("series_id"), F.col("id").alias("idx"))
    labels = readers.label_from_intervals(points, readers.parse_intervals(lists, "t"))
    sums = {r[0]: (r[1], r[2]) for r in labels.groupBy("series_id").agg(F.sum("label"), F.count("*")).collect()}
    assert sums == {"a": (6, 8000), "b": (7001, 8000), "c": (0, 8000)}


def test_array_files(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.save(tmp_path / "v.npy", np.arange(4))
    np.savez(tmp_path / "z.npz", first=np.ones((2, 2)), second=np.zeros(1))
    df = readers.read_arrays(spark, str(tmp_path))
    got = {(r.series_id, r.idx): list(r.x) for r in df.collect()}
    assert got[("m", 2)] == [4.0, 5.0] and got[("v", 3)] == [3.0] and got[("z", 1)] == [1.0, 1.0] and len(got) == 9
    wide = readers.unpack(df.where("series_id = 'm'"), ["p", "q"])
    assert readers.pack(wide, ["p", "q"]).orderBy("idx").first().x == [0.0, 1.0]


def test_array_files_in_row_ranges(spark, tmp_path):
    a = np.arange(60, dtype=np.float32).reshape(20, 3)
    np.save(tmp_path / "c.npy", a)
    np.save(tmp_path / "f.npy", np.asfortranarray(a))
    np.save(tmp_path / "e.npy", a[:0])
    got = readers.read_arrays(spark, str(tmp_path), rows=7).toPandas().sort_values(["series_id", "idx"])
    for sid in "cf":
        own = got[got["series_id"] == sid]
        assert own["idx"].tolist() == list(range(20)) and np.array_equal(np.stack(own["x"]), a)
    assert len(got) == 40


def test_series_of_files_in_folders(spark, tmp_path):
    for folder in ("m1", "m2"):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder / "test.csv", "date,a\n2016-07-01 00:00:00,1\n")
    paths = [f"{tmp_path}/m1/test.csv", f"{tmp_path}/m2/test.csv"]
    assert {r.series_id for r in readers.read_wide_csv(spark, paths).collect()} == {"m1/test", "m2/test"}
    assert {r.series_id for r in readers.read_wide_csv(spark, f"{tmp_path}/*/test.csv").collect()} == {"m1/test", "m2/test"}
    one = readers.read_wide_csv(spark, paths, key=F.lit("all"))
    assert [r.series_id for r in one.collect()] == ["all", "all"]


def test_synthetic_series(spark):
    pdf = synthetic.synthetic_series(spark, 6, 300, seed=1).toPandas().sort_values(["series_id", "idx"])
    x = {s: p["x"].to_numpy() for s, p in pdf.groupby("series_id")}
    t = np.arange(300)
    assert np.allclose(x[0], 10 * np.sin(0.1 * t)) and np.allclose(x[1], 0.5 * t) and np.allclose(x[2], 20 * np.exp(-0.02 * t))
    assert np.diff(x[3]).std() == pytest.approx(0.5, rel=0.2)
    assert x[4].std() == pytest.approx(2.0, rel=0.2) and not np.allclose(x[4], x[5])
    again = synthetic.synthetic_series(spark.newSession(), 6, 300, seed=1).repartition(3).toPandas().sort_values(["series_id", "idx"])
    assert np.allclose(again["x"], pdf["x"])
    wins = synthetic.random_windows(spark, 5, 50, 2).toPandas()
    assert np.stack(wins["f0"]).shape == (5, 50) and not np.allclose(wins["f0"][0], wins["f1"][0])


def _mean_model():
    return lambda w: np.abs(w - w.mean(axis=1, keepdims=True)).mean(axis=2)


def test_files_to_scores_to_file(spark, tmp_path):
    rng = np.random.default_rng(0)
    values = rng.normal(size=(30, 2))
    frame = pd.DataFrame(values, columns=["f1", "f2"])
    frame.insert(0, "date", pd.date_range("2024-01-01", periods=30, freq="h"))
    (tmp_path / "in").mkdir()
    frame.to_csv(tmp_path / "in" / "series.csv", index=False)
    flows.predict_files(spark, str(tmp_path / "in"), _mean_model, 8, str(tmp_path / "out"), 8, stride=4)
    got = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out")).toPandas().sort_values("w_start")
    assert got["w_start"].tolist() == list(range(0, 23, 4))
    w = values[4:12]
    assert np.allclose(got.iloc[1, 2:].to_numpy(dtype=float), np.abs(w - w.mean(0)).mean(1))


def test_metric_history_is_appended(spark, tmp_path):
    one = spark.createDataFrame([(0.5, 2.0)], "mae double, mse double")
    for step in (1, 2):
        sinks.append_metrics(one, str(tmp_path / "h"), "run", step)
    got = spark.read.json(str(tmp_path / "h"))
    assert got.count() == 4 and set(got.columns) == {"run", "ts", "step", "metric", "value"}


def test_scores_of_overlapping_windows(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [4.0, 8.0])], "series_id int, w_start long, s array<double>")
    got = {r.idx: r.score for r in windows.windows_to_points(df, "s").collect()}
    assert got == {0: 1.0, 1: 3.0, 2: 8.0}
    assert {r.idx: r.score for r in windows.windows_to_points(df, "s", how="max").collect()}[1] == 4.0


def test_many_nested_intervals(spark):
    n = 3_000
    points = spark.range(n).select(F.lit("a").alias("series_id"), F.col("id").alias("idx")).unionByName(spark.range(5).select(F.lit("b").alias("series_id"), F.col("id").alias("idx")))
    spans = [("a", 500 + k, 2_500 - k) for k in range(1_000)] + [("a", 2_990, 2_990), ("a", 10, 5), ("a", -7, 1), ("a", 2_998, 9_999), ("c", 0, 9), ("a", 2_501, 2_600)]
    got = readers.label_from_intervals(points, spark.createDataFrame(spans, "series_id string, start long, end long"), block=64)
    on = {r.idx for r in got.where("series_id = 'a' AND label = 1").collect()}
    assert on == {0, 1, *range(500, 2_601), 2_990, 2_998, 2_999}
    assert got.count() == n + 5 and got.where("series_id = 'b' AND label = 1").count() == 0


def test_stacked_files_are_read_per_header(spark, tmp_path):
    for k in range(6):
        lines = ["x, y"] + [f"{k},{j}" for j in range(3)] if k % 2 else ["y ,z"] + [f"{j},{k}" for j in range(2)]
        (tmp_path / f"f{k}.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "empty.csv").write_text("")
    out = readers.read_stacked_csvs(spark, str(tmp_path), types={"z": "int"})
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    assert sorted(out.columns) == ["x", "y", "z"] and dict(out.dtypes)["z"] == "int"
    assert out.where("z IS NULL").count() == 9 and out.where("x IS NULL").count() == 6


def test_labels_join_on_series_and_time(spark, tmp_path):
    for s in ("a", "b"):
        for name, col in (("data", "x"), ("labels", "attack")):
            folder = tmp_path / name / s
            folder.mkdir(parents=True)
            rows = [f"2024-01-01 00:0{i}:00,{(i if name == 'data' else int(s == 'b' and i == 2))}" for i in range(4)]
            (folder / "part.csv").write_text(f"t,{col}\n" + "\n".join(rows) + "\n")
    key = F.regexp_extract(F.col("_metadata.file_path"), "/([ab])/part", 1)
    both = readers.read_labelled(spark, f"{tmp_path}/data/*", f"{tmp_path}/labels/*", key=key, schema="t timestamp, x double", label_schema="t timestamp, attack int")
    assert both.count() == 8
    assert [(r.series_id, r.x) for r in both.where("label = 1").collect()] == [("b", 2.0)]
