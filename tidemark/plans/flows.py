"""Whole jobs composed from the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import decompose, models, scaling, scoring, splits, windows
from tidemark.operators.cleaning import discover_features
from tidemark.operators.ordering import add_index
from tidemark.sources.readers import read_wide_csv
from tidemark.sources.sinks import prediction_columns, write_predictions


def seasonal_residual_alerts(df: DataFrame, kernel: int = 25, col: str = "x") -> DataFrame:
    """Regular series to alerts: split, scale on train, remove the trend, score the rest, threshold on train.

    Input ``series_id, idx, x``; output per series: threshold, number and percentage of alerts.
    """
    cut = splits.split_ratio(df)
    scaled = scaling.scale_splits(cut, [col])
    parts = decompose.decompose(scaled, kernel, col)
    scored = parts.select("series_id", "idx", "split", (F.col("seasonal") * F.col("seasonal")).alias("score"))
    threshold = scoring.sigma_threshold(scored.where("split = 'train'"), by=["series_id"])
    return scoring.alert_summary(scoring.flag(scored, threshold, ["series_id"]), ["series_id"])


def score_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    load: Callable[[], models.Model],
    length: int,
    stride: int = 1,
    task: str = "score",
    schema: str | None = None,
    key: Column | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Files of wide series to one model output per window; ``key`` and ``drop`` as in ``read_wide_csv``."""
    df = read_wide_csv(spark, paths, schema=schema, key=key, drop=drop)
    features = discover_features(df)
    wins = windows.sliding_windows(add_index(df), length, stride, features)
    return models.score_windows(wins, load, task, features, length=length)


def predict_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    load: Callable[[], models.Model],
    length: int,
    output: str,
    width: int,
    stride: int = 1,
    schema: str | None = None,
    fmt: str = "csv",
    key: Column | None = None,
) -> None:
    """Files in, scores out, one call."""
    scored = score_files(spark, paths, load, length, stride, "score", schema, key)
    write_predictions(prediction_columns(scored, "out", width, "anomaly_detection"), output, fmt)
