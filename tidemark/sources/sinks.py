"""Sinks: predictions as columns, metric history as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column name stems per task.
STEMS = {
    "forecast": "pred",
    "anomaly_detection": "anomaly_score",
    "classification": "class_prob",
}


def prediction_columns(
    df: DataFrame, col: str, width: int, task: str = "forecast", keep: Sequence[str] = ("series_id", "w_start")
) -> DataFrame:
    """Array column spread to ``<stem>_0``, ``<stem>_1``, ... next to the window keys."""
    stem = STEMS[task]
    return df.select(*keep, *[F.col(col)[i].alias(f"{stem}_{i}") for i in range(width)])


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write from all tasks; CSV files get a header."""
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def metric_rows(metrics: DataFrame, run: str, step: int, keys: Sequence[str] = ()) -> DataFrame:
    """Long form ``run, ts, step, keys, metric, value`` of a wide metric frame."""
    names = [c for c in metrics.columns if c not in keys]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]))
    return metrics.select(*keys, pairs.alias("_m")).select(
        F.lit(run).alias("run"), F.current_timestamp().alias("ts"), F.lit(step).alias("step"), *keys, "_m.metric", "_m.value"
    )


def append_metrics(metrics: DataFrame, path: str, run: str, step: int, keys: Sequence[str] = (), fmt: str = "json") -> None:
    """Append one batch of metric rows to the run's history."""
    metric_rows(metrics, run, step, keys).write.mode("append").format(fmt).save(path)
