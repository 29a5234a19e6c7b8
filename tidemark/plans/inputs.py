"""Series built from the given tables, with the SQL that builds the same rows.

* ``points``  every event of a user: irregular series, unique (ts, event_id)
* ``hourly``  mean event value per event type and hour: regular series with gaps
* ``daily``   order count, sum and mean per priority and day: multivariate series
* ``pairs``   forecast pairs: catalogue price times quantity against the price paid
* ``shapes``  fixed-length labelled windows (one embedding is one window of 64 points)

Indexed series are stored once, so the steps behind them do not repeat the indexing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordering import add_index, time_chunk
from tidemark.session import staged

DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exact_sum(col: str):
    """Sum of two-decimal amounts without rounding error, so the order of addition cannot matter."""
    return F.sum(F.col(col).cast("decimal(18,2)")).cast("double")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select(
        F.col("user_id").alias("series_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("x")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(add_index(events(spark, sf_dir), order=["ts", "event_id"]))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    means = df.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(
        (_exact_sum("value") / F.count(F.lit(1))).alias("x")
    )
    indexed = staged(add_index(means, chunk=time_chunk("ts", 10 * DAY)))
    return indexed.withColumn("label", F.when(F.hour("ts").between(8, 11), 1).otherwise(0))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    per_day = df.groupBy(
        F.col("o_orderpriority").alias("series_id"), F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("ts")
    ).agg(F.count(F.lit(1)).cast("double").alias("orders"), _exact_sum("o_totalprice").alias("total"))
    per_day = per_day.withColumn("mean", F.col("total") / F.col("orders"))
    return staged(add_index(per_day, chunk=time_chunk("ts", 365 * DAY)))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast pairs; horizon is the line number, feature the return flag."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice"
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return items.join(parts, "l_partkey").select(
        F.col("l_returnflag").alias("series_id"),
        F.col("l_linenumber").alias("h"),
        F.col("l_extendedprice").alias("true"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("pred"),
        F.when(F.col("l_quantity") > 10, 1.0).otherwise(0.0).alias("mask"),
    )


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return df.select(
        F.col("vec_id").alias("window_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("int").alias("label")
    )


# -- the same rows in SQL ---------------------------------------------------------------------------

POINTS_SQL = """
points AS (
  SELECT user_id AS series_id, event_id, ts, event_type, value AS x,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx
  FROM events)"""

HOURLY_SQL = """
hourly AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx,
         CASE WHEN hour(ts) BETWEEN 8 AND 11 THEN 1 ELSE 0 END AS label
  FROM (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
               CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS x
        FROM events GROUP BY 1, 2))"""

DAILY_SQL = """
daily AS (
  SELECT *, total / orders AS mean, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx
  FROM (SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts,
               CAST(count(*) AS DOUBLE) AS orders,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM orders GROUP BY 1, 2))"""

PAIRS_SQL = """
pairs AS (
  SELECT l_returnflag AS series_id, l_linenumber AS h, l_extendedprice AS actual,
         l_quantity * p_retailprice AS pred, CASE WHEN l_quantity > 10 THEN 1.0 ELSE 0.0 END AS mask
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

SHAPES_SQL = """
shapes AS (
  SELECT vec_id AS window_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"""


def windows_sql(source: str, length: int, stride: int, cols: str = "x", name: str = "wins") -> str:
    """Window rows in long form: one row per window and point."""
    picked = ", ".join(f"p.{c.strip()}" for c in cols.split(","))
    return f"""
sizes AS (SELECT series_id, count(*) AS n FROM {source} GROUP BY 1),
starts AS (SELECT series_id, unnest(range(0, n - {length} + 1, {stride})) AS w_start FROM sizes WHERE n >= {length}),
{name} AS (
  SELECT s.series_id, s.w_start, p.idx - s.w_start AS pos, p.idx, {picked}
  FROM starts s JOIN {source} p ON p.series_id = s.series_id AND p.idx BETWEEN s.w_start AND s.w_start + {length - 1})"""
