"""Streaming replays of the events table, run to completion and read back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import models, windows
from tidemark.operators.scoring import sigma_threshold
from tidemark.plans.inputs import POINTS_SQL, events, points, windows_sql
from tidemark.plans.model_queries import _median_model
from tidemark.plans.registry import query, r, rsql
from tidemark.plans.source_queries import fresh_folder
from tidemark.streaming import scoring as stream

ROUNDS, FILES, FILE_ROWS = 3, 2, 250_000


def event_files(spark: SparkSession, sf: str) -> tuple[str, int]:
    """The events as files that arrive in ROUNDS spans of time, and the files of a span.

    The rows of a span are dealt in turn to FILES files, or to more, of FILE_ROWS rows each, where it has many rows.
    Every span has the same number of files, so a small one sets a limit to it; one without rows has none.
    """
    df = events(spark, sf)
    lo, hi = df.select(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    span = F.least(F.floor((F.unix_micros("ts") - lo) * ROUNDS / (hi - lo + 1)), F.lit(ROUNDS - 1))
    rows = dict(df.groupBy(span.alias("span")).count().where("span IS NOT NULL").collect())
    files = max(1, min(max(FILES, -(-max(rows.values()) // FILE_ROWS)), min(rows.values()) // 100))
    path = fresh_folder(spark, "events")
    for n in sorted(rows):
        df.where(span == n).repartition(files).write.mode("append").parquet(path)
    return path, files


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event files as a stream of one span of time per micro-batch, its rows unordered across files."""
    path, files = event_files(spark, sf)
    return spark.readStream.schema(events(spark, sf).schema).option("maxFilesPerTrigger", files).parquet(path)


def play(state: stream.WindowStream, source: DataFrame, emit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a window stream over all present files and read its output."""
    state.writer(source, emit).trigger(availableNow=True).start().awaitTermination()
    return state.read(source.sparkSession).drop("batch")


def replay(out: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame over all present files into Parquet and read the result."""
    spark = out.sparkSession
    path, state = fresh_folder(spark, name), fresh_folder(spark, f"{name}-state")
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode(mode).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


STREAM_SQL = f"""{POINTS_SQL}, {windows_sql('points', 12, 1)},
m AS (SELECT series_id, w_start, median(x) AS m FROM wins GROUP BY 1, 2),
s AS (SELECT w.series_id, w.w_start + 11 AS idx, avg(abs(x - m)) AS score FROM wins w JOIN m ON m.series_id = w.series_id AND m.w_start = w.w_start GROUP BY 1, 2)"""


ORDER = ("ts", "event_id")


def _mean_score(scored: DataFrame) -> DataFrame:
    mean = F.aggregate("out", F.lit(0.0), lambda a, v: a + v) / F.size("out")
    return scored.select("series_id", "idx", mean.alias("score"))


@query("stream_scores", f"WITH {STREAM_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('score')} AS score FROM s")
def stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    state = stream.WindowStream(fresh_folder(spark, "scores"), 12, order=ORDER)
    out = play(state, event_stream(spark, sf), lambda wins: _mean_score(stream.scores(wins, _median_model)))
    return out.withColumn("score", r("score"))


@query("stream_alerts", f"WITH {STREAM_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('score')} AS score, 60.0::DOUBLE AS threshold FROM s WHERE score > 60")
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    state = stream.WindowStream(fresh_folder(spark, "alerts"), 12, order=ORDER)
    out = play(state, event_stream(spark, sf), lambda wins: stream.alerts(_mean_score(stream.scores(wins, _median_model)), 60.0))
    return out.withColumn("score", r("score"))


@query(
    "stream_alerts_sigma",
    f"""WITH {STREAM_SQL}, lim AS (SELECT series_id, round(avg(score) + 1.5 * stddev_pop(score), 6) AS threshold FROM s WHERE idx < 40 GROUP BY 1)
SELECT s.series_id, CAST(idx AS BIGINT) AS idx, {rsql('score')} AS score, threshold FROM s JOIN lim ON lim.series_id = s.series_id WHERE round(score, 6) > threshold""",
)
def stream_alerts_sigma(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds learned per series from its first points lie in a folder that every micro-batch reads again."""
    wins = windows.sliding_windows(points(spark, sf).where("idx < 40"), 12, 1)
    known = models.score_windows(wins, _median_model, "score", length=12).withColumn("idx", F.col("w_start") + 11)
    limits = fresh_folder(spark, "limits")
    by_series = sigma_threshold(_mean_score(known), by=["series_id"], sigmas=1.5)
    by_series.withColumn("threshold", r("threshold")).write.parquet(limits)
    state = stream.WindowStream(fresh_folder(spark, "alerts"), 12, order=ORDER)

    def emit(wins: DataFrame) -> DataFrame:
        scored = _mean_score(stream.scores(wins, _median_model))
        return stream.alerts(scored.withColumn("score", r("score")), limits)

    return play(state, event_stream(spark, sf), emit).select("series_id", "idx", "score", "threshold")


def _drift_model():
    """Example model: the last point plus the mean step of the window, two steps ahead."""
    return lambda w: w[:, -1:, :] + np.arange(1, 3)[None, :, None] * (w[:, -1:, :] - w[:, :1, :]) / (w.shape[1] - 1)


@query(
    "stream_forecast",
    f"""WITH {POINTS_SQL}, h AS (SELECT unnest([1, 2]) AS h)
SELECT a.series_id, CAST(a.idx AS BIGINT) AS idx, h, {rsql('a.x + h * (a.x - b.x) / 11')} AS pred_x FROM points a JOIN points b ON b.series_id = a.series_id AND b.idx = a.idx - 11, h""",
)
def stream_forecast(spark: SparkSession, sf: str) -> DataFrame:
    state = stream.WindowStream(fresh_folder(spark, "forecasts"), 12, order=ORDER)
    out = play(state, event_stream(spark, sf), lambda wins: stream.forecasts(wins, _drift_model))
    return out.select("series_id", "idx", "h", r("pred_x").alias("pred_x"))


@query(
    "stream_reset",
    """WITH e AS (SELECT user_id AS series_id, event_id, ts, event_type = 'error' AS reset, value AS x,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id, run ORDER BY ts, event_id) - 1 AS idx FROM e WHERE NOT reset)
SELECT series_id, CAST(epoch_us(ts) AS BIGINT) AS at, CAST(idx AS BIGINT) AS idx, CAST(least(idx + 1, 5) AS INTEGER) AS filled, idx + 1 >= 5 AS ready,
  round(sum(x) OVER (PARTITION BY series_id, run ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) + 0 AS total FROM p""",
)
def stream_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Events of type error are control rows: each empties the buffer of its series."""
    source = event_stream(spark, sf).withColumn("reset", F.col("event_type") == "error")
    state = stream.WindowStream(fresh_folder(spark, "reset"), 5, order=ORDER, control="reset")
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return play(state, source, lambda wins: wins.select("series_id", F.unix_micros("ts").alias("at"), "idx", "filled", "ready", r(total, 4).alias("total")))


@query(
    "stream_buffer_status",
    f"WITH {POINTS_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, 12 AS filled, CAST(least(idx + 1, 12) AS INTEGER) AS real, 12 AS required, idx + 1 >= 12 AS ready FROM points",
)
def stream_buffer_status(spark: SparkSession, sf: str) -> DataFrame:
    """Zero-filled start: the buffer is full from the first point on, ready counts real points."""
    state = stream.WindowStream(fresh_folder(spark, "status"), 12, order=ORDER, warm_start=True)
    return play(state, event_stream(spark, sf), lambda wins: wins.select("series_id", "idx", "filled", "real", "required", "ready"))


@query(
    "stream_regular",
    f"""WITH w AS (SELECT event_type AS series_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, avg(value) AS x, count(*) AS n FROM events GROUP BY 1, 2),
hi AS (SELECT max(epoch(ts)) - 3600 AS mark FROM events)
SELECT series_id, day, {rsql('x')} AS x, n FROM w, hi WHERE (day + 1) * 86400 <= mark""",
)
def stream_regular(spark: SparkSession, sf: str) -> DataFrame:
    """Daily means of the stream; the day still open under the watermark is not emitted."""
    source = event_stream(spark, sf).drop("series_id").withColumnRenamed("event_type", "series_id")
    out = replay(stream.regular_stream(source, 86_400, "1 hour"), "regular")
    day = F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)).cast("long")
    return out.select("series_id", day.alias("day"), r("x").alias("x"), "n")
