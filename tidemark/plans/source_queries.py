"""Label intervals, synthetic shapes, file round trips and the flagship job, over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import models, windows
from tidemark.operators.ordering import epoch_micros
from tidemark.plans import flows
from tidemark.plans.draws_sql import Sql, normal
from tidemark.plans.inputs import HOURLY_SQL, POINTS_SQL, daily, hourly, points, windows_sql
from tidemark.plans.model_queries import _median_model
from tidemark.plans.registry import query, r, rsql
from tidemark.session import shared_folder
from tidemark.sources import readers, sinks, synthetic


@query(
    "label_intervals",
    f"""WITH {POINTS_SQL}, iv AS (SELECT series_id, idx AS s, idx + CASE WHEN x > 150 THEN 4 ELSE 0 END AS e FROM points WHERE x > 90)
SELECT p.series_id, CAST(p.idx AS BIGINT) AS idx, CASE WHEN EXISTS (SELECT 1 FROM iv WHERE iv.series_id = p.series_id AND p.idx BETWEEN s AND e) THEN 1 ELSE 0 END AS label FROM points p""",
)
def label_intervals(spark: SparkSession, sf: str) -> DataFrame:
    pts = points(spark, sf)
    # one interval per text: a pair for large values, a single index for medium ones
    text = F.when(F.col("x") > 150, F.concat(F.lit("[["), "idx", F.lit(","), F.col("idx") + 4, F.lit("]]"))).otherwise(
        F.concat(F.lit("["), "idx", F.lit("]"))
    )
    lists = pts.where("x > 90").select("series_id", text.alias("sequences"))
    return readers.label_from_intervals(pts, readers.parse_intervals(lists, "sequences"), block=32).select("series_id", "idx", "label")


@query(
    "synthetic_shapes",
    f"WITH {POINTS_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('10 * sin(0.1 * idx)')} AS sine, {rsql('0.5 * idx')} AS trend, {rsql('20 * exp(-0.02 * idx)')} AS decay FROM points",
)
def synthetic_shapes(spark: SparkSession, sf: str) -> DataFrame:
    out = synthetic.add_shapes(points(spark, sf))
    return out.select("series_id", "idx", r("sine").alias("sine"), r("trend").alias("trend"), r("decay").alias("decay"))


PLACE = (Sql("series_id"), Sql("idx"))


@query(
    "synthetic_random_shapes",
    f"""WITH {POINTS_SQL}, d AS (SELECT series_id, idx, {normal(0, 'walk', *PLACE)} * 0.5 AS step, {normal(0, 'noise', *PLACE)} * 2 AS noise FROM points)
SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('sum(step) OVER (PARTITION BY series_id ORDER BY idx)')} AS walk, {rsql('noise')} AS noise FROM d""",
)
def synthetic_random_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return synthetic.add_shapes(points(spark, sf)).select("series_id", "idx", r("walk").alias("walk"), r("noise").alias("noise"))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that driver and executors share."""
    base = shared_folder(spark)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base}/{name}-{uuid.uuid4().hex}"


BY_FILE = "series=([^/]+)/"


def _series_files(df: DataFrame, name: str) -> str:
    """One folder of CSV files per series."""
    path = fresh_folder(df.sparkSession, name)
    df.withColumnRenamed("series_id", "series").write.partitionBy("series").option("header", True).csv(path)
    return path


@query(
    "labelled_files",
    f"WITH {HOURLY_SQL} SELECT series_id, CAST(epoch(ts) AS BIGINT) AS at, {rsql('x')} AS x, CAST(label AS INTEGER) AS label FROM hourly WHERE label IS NOT NULL",
)
def labelled_files(spark: SparkSession, sf: str) -> DataFrame:
    """Features and labels of all series in two sets of files, joined on series and time."""
    df = hourly(spark, sf)
    data = _series_files(df.select("series_id", F.col("ts").alias("stamp"), "x"), "data")
    labels = _series_files(df.select("series_id", F.col("ts").alias("time"), F.col("label").alias("attack")), "labels")
    both = readers.read_labelled(spark, data, labels, key=F.col("series"), schema="stamp timestamp, x double", label_schema="time timestamp, attack int")
    return both.select("series_id", F.floor(epoch_micros("stamp") / 1_000_000).cast("long").alias("at"), r("x").alias("x"), F.col("label").cast("int").alias("label"))


@query(
    "stacked_files",
    f"""WITH {HOURLY_SQL} SELECT series_id AS name, CASE WHEN length(series_id) % 2 = 0 THEN CAST(epoch(ts) AS BIGINT) END AS at, CASE WHEN length(series_id) % 2 = 1 THEN CAST(idx AS BIGINT) END AS idx, {rsql('x')} AS x FROM hourly""",
)
def stacked_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of two layouts in one folder, stacked by column name."""
    df = hourly(spark, sf).withColumn("at", F.floor(epoch_micros("ts") / 1_000_000).cast("long"))
    path = fresh_folder(spark, "stacked")
    even = F.length("series_id") % 2 == 0
    df.where(even).select(F.col("series_id").alias(" name"), "at", F.col("x").alias("x ")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/a")
    df.where(~even).select("x", F.col("series_id").alias("name"), "idx").write.option("header", True).csv(f"{path}/b")
    out = readers.read_stacked_csvs(spark, path, types={"name": "string", "at": "bigint", "idx": "bigint"})
    return out.select("name", "at", "idx", r("x").alias("x"))


@query(
    "score_files",
    f"""WITH {HOURLY_SQL}, {windows_sql('hourly', 24, 12)}, m AS (SELECT series_id, w_start, median(x) AS m FROM wins GROUP BY 1, 2)
SELECT w.series_id, w.w_start, {rsql('avg(abs(x - m))')} AS score FROM wins w JOIN m ON m.series_id = w.series_id AND m.w_start = w.w_start GROUP BY 1, 2""",
)
def score_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files in, window scores out, in one call."""
    path = _series_files(hourly(spark, sf).select("series_id", "ts", "x"), "wide")
    name = F.regexp_extract(F.col("_metadata.file_path"), BY_FILE, 1)
    out = flows.score_files(spark, path, _median_model, 24, 12, schema="ts timestamp, x double", key=name, drop=["series"])
    return out.select("series_id", "w_start", r(F.aggregate("out", F.lit(0.0), lambda a, v: a + v) / F.size("out")).alias("score"))


@query("csv_round_trip", f"WITH {HOURLY_SQL} SELECT series_id, CAST(epoch(ts) AS BIGINT) AS at, {rsql('x')} AS x FROM hourly")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly series written as `;`-separated CSV with padded names, read back as wide series."""
    path = fresh_folder(spark, "csv")
    out = hourly(spark, sf).select(F.col("ts").alias(" ts"), F.col("x").alias(" x "), F.col("series_id").alias("name"))
    out.write.option("header", True).option("sep", ";").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = readers.read_trimmed_csv(spark, path, ";", "ts string, x double, name string")
    return back.select(
        F.col("name").alias("series_id"), F.floor(epoch_micros(F.to_timestamp("ts")) / 1_000_000).cast("long").alias("at"), r("x").alias("x")
    )


@query(
    "prediction_columns",
    f"""WITH {POINTS_SQL}, {windows_sql('points', 24, 24)}, m AS (SELECT series_id, w_start, median(x) AS m FROM wins GROUP BY 1, 2)
SELECT w.series_id, w.w_start, """
    + ", ".join(rsql(f"max(abs(x - m)) FILTER (pos = {i})") + f" AS anomaly_score_{i}" for i in range(24))
    + " FROM wins w JOIN m ON m.series_id = w.series_id AND m.w_start = w.w_start GROUP BY 1, 2",
)
def prediction_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Model scores written as Parquet columns and read back."""
    scored = models.score_windows(windows.sliding_windows(points(spark, sf), 24, 24), _median_model, "score")
    path = fresh_folder(spark, "predictions")
    sinks.write_predictions(sinks.prediction_columns(scored, "out", 24, "anomaly_detection"), path, "parquet")
    back = spark.read.parquet(path)
    return back.withColumns({f"anomaly_score_{i}": r(f"anomaly_score_{i}") for i in range(24)})


@query("metric_rows", "SELECT o_orderpriority AS series_id, 'nightly' AS run, 3 AS step, 'orders' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1")
def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    metrics = daily(spark, sf).groupBy("series_id").agg(F.sum("orders").alias("orders"))
    return sinks.metric_rows(metrics, "nightly", 3, ["series_id"]).drop("ts")


FLAGSHIP_SQL = f"""WITH {HOURLY_SQL},
sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM hourly),
cut AS (SELECT *, idx < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS train FROM sized),
fit AS (SELECT series_id, avg(x) AS m, stddev_pop(x) AS s FROM cut WHERE train GROUP BY 1),
sc AS (SELECT c.series_id, c.idx, c.n, c.train, (c.x - f.m) / f.s AS x FROM cut c JOIN fit f ON f.series_id = c.series_id),
offs AS (SELECT unnest(range(-12, 13)) AS o),
ma AS (SELECT c.series_id, c.idx, any_value(c.train) AS train, any_value(c.x) AS x, avg(p.x) AS trend
       FROM sc c, offs o JOIN sc p ON p.series_id = c.series_id AND p.idx = least(greatest(c.idx + o.o, 0), c.n - 1) GROUP BY 1, 2),
score AS (SELECT series_id, train, pow(x - trend, 2) AS score FROM ma),
t AS (SELECT series_id, avg(score) + 2 * stddev_pop(score) AS threshold FROM score WHERE train GROUP BY 1)
SELECT s.series_id, {rsql('max(threshold)')} AS threshold, count(*) FILTER (score > threshold) AS anomalies_detected, {rsql('100.0 * count(*) FILTER (score > threshold) / count(*)')} AS anomaly_rate
FROM score s JOIN t ON t.series_id = s.series_id GROUP BY 1"""


@query("seasonal_residual_alerts", FLAGSHIP_SQL)
def seasonal_residual_alerts(spark: SparkSession, sf: str) -> DataFrame:
    out = flows.seasonal_residual_alerts(hourly(spark, sf))
    return out.withColumns({"threshold": r("threshold"), "anomaly_rate": r("anomaly_rate")})
