"""Synthetic shapes over an existing index, and whole synthetic series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.draws import normal
from tidemark.operators.ordering import CHUNK, idx_chunk, running_totals

# Parameters of the shapes.
SHAPES = ("sine", "trend", "decay", "walk", "noise")
SINE_HEIGHT, SINE_RATE = 10.0, 0.1
TREND_RATE = 0.5
DECAY_HEIGHT, DECAY_RATE = 20.0, 0.02
WALK_SIGMA, NOISE_SIGMA = 0.5, 2.0


def add_shapes(df: DataFrame, keys: Sequence[str] = ("series_id",), idx: str = "idx", seed: int = 0, block: int = 4096) -> DataFrame:
    """Add one column per shape: sine, linear trend, exponential decay, random walk, noise.

    Random parts are hashes of (seed, key, index); the walk is a two-level running sum.
    """
    t = F.col(idx).cast("double")
    place = [F.col(k) for k in (*keys, idx)]
    step = normal(seed, "walk", *place) * WALK_SIGMA
    shaped = df.withColumns(
        {
            "sine": SINE_HEIGHT * F.sin(SINE_RATE * t),
            "trend": TREND_RATE * t,
            "decay": DECAY_HEIGHT * F.exp(-DECAY_RATE * t),
            "noise": normal(seed, "noise", *place) * NOISE_SIGMA,
            CHUNK: idx_chunk(idx, block),
        }
    )
    return running_totals(shaped, keys, [idx], {"walk": step}).drop(CHUNK)


def synthetic_series(spark: SparkSession, series: int, length: int, seed: int = 0) -> DataFrame:
    """Series 0, 1, 2, 3 follow sine, trend, decay and walk, all others noise: ``series_id, idx, x``."""
    grid = spark.range(series * length).select(
        F.floor(F.col("id") / length).cast("long").alias("series_id"), (F.col("id") % length).alias("idx")
    )
    shaped = add_shapes(grid, seed=seed)
    x = F.col("noise")
    for i, name in enumerate(SHAPES[:4]):
        x = F.when(F.col("series_id") == i, F.col(name)).otherwise(x)
    return shaped.select("series_id", "idx", x.alias("x"))


def random_windows(spark: SparkSession, count: int, length: int, features: int, seed: int = 0) -> DataFrame:
    """Windows of standard normal values, the stand-in when a dataset is absent: ``window_id, f0, f1, ...``."""
    steps = F.sequence(F.lit(0), F.lit(length - 1))
    cols = [_feature(steps, f, seed) for f in range(features)]
    return spark.range(count).withColumnRenamed("id", "window_id").select("window_id", *cols)


def _feature(steps, f: int, seed: int):
    return F.transform(steps, lambda i: normal(seed, "window", f, F.col("window_id"), i)).alias(f"f{f}")
