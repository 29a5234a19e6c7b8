from __future__ import annotations

import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators import models, ordering, windows
from tidemark.plans import source_queries, stream_queries
from tidemark.streaming import scoring as stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "series_id string, ts timestamp, x double, reset boolean"


def _last_minus_mean():
    return lambda w: (w[:, -1, :] - w.mean(axis=1)).mean(axis=1)


def _next_two():
    return lambda w: w[:, -1:, :] + np.arange(1, 3)[None, :, None]


@pytest.fixture
def inbox(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()

    def put(rows):
        df = spark.createDataFrame(rows, "series_id string, t long, x double, reset boolean")
        df.select("series_id", F.timestamp_seconds("t").alias("ts"), "x", "reset").coalesce(2).write.mode("append").parquet(str(box))

    return box, put


def run(df, tmp_path, name="out", mode="append"):
    query = (
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state"))
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def source(spark, box):
    return spark.readStream.schema(SCHEMA).parquet(str(box))


def play(state, stream_df, emit):
    state.writer(stream_df, emit).trigger(availableNow=True).start().awaitTermination()


def plain(wins):
    return wins.select("series_id", "run", "idx", "ts", "filled", "real", "ready", "x")


def test_scores_across_a_restart_equal_the_batch_windows(spark, tmp_path, inbox):
    box, put = inbox
    rng = np.random.default_rng(0)
    rows = [(s, i, float(rng.normal()), False) for s in ("a", "b") for i in range(40)]
    state = stream.WindowStream(str(tmp_path / "state"), 6)
    emit = lambda wins: stream.scores(wins, _last_minus_mean)
    put([r for r in rows if r[1] < 3])
    play(state, source(spark, box), emit)
    put([r for r in rows if 3 <= r[1] < 17])
    play(state, source(spark, box), emit)
    put(sorted((r for r in rows if r[1] >= 17), key=lambda r: -r[1]))  # unordered inside the batch
    play(state, source(spark, box), emit)
    got = state.read(spark).toPandas().set_index(["series_id", "idx"])["out"].map(lambda v: v[0])

    df = spark.createDataFrame(rows, "series_id string, idx long, x double, reset boolean")
    batch = models.score_windows(windows.sliding_windows(df, 6, 1), _last_minus_mean, "score").toPandas()
    want = {(r.series_id, r.w_start + 5): r.out[0] for r in batch.itertuples()}
    assert set(got.index) == set(want)
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


@pytest.mark.parametrize("rows", [4, 7, None])
def test_many_small_batches_with_compaction(spark, tmp_path, inbox, monkeypatch, rows):
    monkeypatch.setattr(stream, "COMPACT", 3)
    box, put = inbox
    for k in range(8):  # b is silent in most batches
        put([("a", 10 * k + i, float(10 * k + i), False) for i in range(k % 3 + 1)] + ([("b", k, float(k), False)] if k % 4 == 0 else []))
    state = stream.WindowStream(str(tmp_path / "state"), 6, rows=rows)
    play(state, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(box)), plain)
    assert state.read(spark).select("batch").distinct().count() >= 6
    got = {(r.series_id, r.idx): list(r.x) for r in state.read(spark).collect()}
    series = {"a": [float(10 * k + i) for k in range(8) for i in range(k % 3 + 1)], "b": [0.0, 4.0]}
    assert got == {(s, i): v[max(0, i - 5) : i + 1] for s, v in series.items() for i in range(len(v))}


def test_a_batch_that_runs_again_replaces_its_output(spark, tmp_path):
    state = stream.WindowStream(str(tmp_path / "state"), 3)
    frame = lambda lo, hi: spark.createDataFrame([("a", i, float(i)) for i in range(lo, hi)], "series_id string, ts long, x double")
    state.run_batch(frame(0, 5), 0, plain)
    for _ in range(2):
        state.run_batch(frame(5, 9), 1, plain)
    state.run_batch(frame(9, 9), 2, plain)
    state.run_batch(frame(9, 10), 3, plain)
    got = state.read(spark).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(10))
    assert list(got[-1].x) == [7.0, 8.0, 9.0]


def test_zero_filled_start_and_status(spark, tmp_path, inbox):
    box, put = inbox
    put([("a", i, float(i + 1), False) for i in range(5)])
    state = stream.WindowStream(str(tmp_path / "state"), 4, warm_start=True)
    play(state, source(spark, box), plain)
    got = state.read(spark).orderBy("idx").collect()
    assert [list(r.x) for r in got][:2] == [[0, 0, 0, 1], [0, 0, 1, 2]]
    assert [r.filled for r in got] == [4] * 5
    assert [r.real for r in got] == [1, 2, 3, 4, 4] and [r.ready for r in got] == [False] * 3 + [True] * 2


def test_reset_row_starts_over(spark, tmp_path, inbox):
    box, put = inbox
    state = stream.WindowStream(str(tmp_path / "state"), 3, control="reset")
    put([("a", i, float(i), i in (0, 5, 6)) for i in range(10)] + [("b", 1, 1.0, False), ("b", 2, 2.0, True)])
    play(state, source(spark, box), plain)
    put([("a", 10, 10.0, False), ("b", 3, 3.0, False)])
    play(state, source(spark, box), plain)
    got = state.read(spark).orderBy("ts").toPandas()
    a = got[got.series_id == "a"]
    assert a["idx"].tolist() == [0, 1, 2, 3, 0, 1, 2, 3]
    assert [list(w) for w in a["x"]][4:] == [[7.0], [7.0, 8.0], [7.0, 8.0, 9.0], [8.0, 9.0, 10.0]]
    assert got[got.series_id == "b"]["idx"].tolist() == [0, 0]


def test_hot_series_is_no_hot_task(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = 60_000
        rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 997)).alias("series_id"), F.col("id").alias("ts"), F.rand(1).alias("x"))
        state = stream.WindowStream(str(tmp_path / "state"), 8, rows=128)
        tails = spark.createDataFrame([("hot", 100, [(1.0,)] * 7)], "series_id string, next long, tail array<struct<x:double>>")
        share = lambda df, c: df.groupBy(F.spark_partition_id()).agg(c.alias("n")).agg(F.max("n") / F.sum("n")).first()[0]
        assert share(state.numbered(rows), F.count("pos")) < 0.1
        blocks = state.blocks(rows, tails)
        assert share(blocks, F.sum(F.size("points"))) < 0.1
        wins = state.windows(blocks)
        assert share(wins, F.sum(F.size("x"))) < 0.1
        assert wins.count() == n
        hot = wins.where("series_id = 'hot'").agg(F.min("idx"), F.max("idx"), F.min("filled")).first()
        assert tuple(hot) == (100, 100 + n // 3 - 1, 8)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_silent_series_starts_over(spark, tmp_path, inbox):
    box, put = inbox
    state = stream.WindowStream(str(tmp_path / "state"), 3, silence_ms=60_000)
    put([("a", i, float(i), False) for i in range(4)])
    play(state, source(spark, box), plain)
    put([("a", 50, 50.0, False)])
    play(state, source(spark, box), plain)
    time.sleep(1)
    put([("a", 100, 100.0, False)])
    play(stream.WindowStream(state.folder, 3, silence_ms=500), source(spark, box), plain)
    assert [r.idx for r in state.read(spark).orderBy("ts").collect()] == [0, 1, 2, 3, 4, 0]


def test_thresholds_are_read_again_by_every_batch(spark, tmp_path, inbox):
    box, put = inbox
    limits = str(tmp_path / "limits")
    limit = lambda v: spark.createDataFrame([("a", v)], "series_id string, threshold double").write.mode("overwrite").parquet(limits)
    state = stream.WindowStream(str(tmp_path / "state"), 1)
    emit = lambda wins: stream.alerts(wins.withColumn("score", F.col("x")[0]), limits)
    limit(2.0)
    put([("a", i, float(i), False) for i in range(5)])
    play(state, source(spark, box), emit)
    limit(6.0)
    put([("a", i, float(i), False) for i in range(5, 9)])
    play(state, source(spark, box), emit)
    assert sorted(r.score for r in state.read(spark).collect()) == [3.0, 4.0, 7.0, 8.0]


def test_forecast_rows(spark, tmp_path, inbox):
    box, put = inbox
    put([("a", i, float(i), False) for i in range(4)])
    state = stream.WindowStream(str(tmp_path / "state"), 3)
    play(state, source(spark, box), lambda wins: stream.forecasts(wins, _next_two))
    got = sorted((r.idx, r.h, r.pred_x) for r in state.read(spark).collect())
    assert got == [(2, 1, 3.0), (2, 2, 4.0), (3, 1, 4.0), (3, 2, 5.0)]


def test_late_rows_are_dropped(spark, tmp_path, inbox):
    box, put = inbox
    make = lambda: stream.regular_stream(source(spark, box), 10, "20 seconds")
    put([("a", t, 1.0, False) for t in (0, 5, 12, 100)])
    run(make(), tmp_path)
    put([("a", 3, 99.0, False), ("a", 200, 1.0, False)])
    run(make(), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r.ts.second, r.x, r.n) for r in got][:2] == [(0, 1.0, 2), (10, 1.0, 1)]


def test_alerts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 3.0)], "series_id string, score double")
    limits = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "series_id string, threshold double")
    assert [(r.series_id, r.score) for r in stream.alerts(df, limits).collect()] == [("a", 3.0)]
    assert stream.alerts(df, 0.0).count() == 3
    assert ordering.series_lengths(df).count() == 2


@pytest.fixture
def events_folder(spark, tmp_path, monkeypatch):
    """A writer of an events table from its times in hours, with the folder that queries share."""
    monkeypatch.setattr(source_queries, "shared_folder", lambda _: str(tmp_path / "shared"))

    def put(hours):
        rows = [(i, int(h * 3600), i % 3, "view", float(i)) for i, h in enumerate(hours)]
        df = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double")
        df.select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "event_type", "value").write.parquet(str(tmp_path / "sf" / "events.parquet"))
        return str(tmp_path / "sf")

    return put


def test_large_spans_are_written_by_more_tasks(spark, tmp_path, events_folder, monkeypatch):
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 200, raising=False)
    sf = events_folder([i / 100 for i in range(3_000)])
    out = stream_queries.stream_buffer_status(spark, sf)
    files = spark.read.parquet(f"{tmp_path}/shared/events-*").groupBy(F.input_file_name()).agg(F.min("ts").alias("lo"), F.count(F.lit(1)).alias("n")).collect()
    assert len(files) == 15 and max(r.n for r in files) < 400
    assert out.count() == 3_000 and out.where("NOT ready").count() == 33


@pytest.mark.parametrize("middle", [[], [50.0]])
def test_a_span_of_few_rows_does_not_split_the_next(spark, events_folder, middle):
    hours = [i / 10 for i in range(300)] + middle + [70 + i / 10 for i in range(300)]
    got = stream_queries.stream_forecast(spark, events_folder(hours)).where("h = 1").collect()
    series = {s: [float(i) for i in range(len(hours)) if i % 3 == s] for s in range(3)}
    want = {(s, i): round(v[i] + (v[i] - v[i - 11]) / 11, 6) for s, v in series.items() for i in range(11, len(v))}
    assert {(r.series_id, r.idx): round(r.pred_x, 6) for r in got} == want


def test_short_series_of_a_batch_are_numbered_without_a_join(spark, tmp_path):
    """Short series take one shuffle to be numbered, and no join with a table as long as the batch."""
    rows = spark.range(2_000).select((F.col("id") % 100).alias("series_id"), F.col("id").alias("ts"), F.col("id").cast("double").alias("x"))
    numbered = stream.WindowStream(str(tmp_path / "state"), 4).numbered(rows)
    assert "Join" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    assert numbered.where(F.col("pos") != F.floor(F.col("ts") / 100)).count() == 0 and numbered.count() == 2_000
