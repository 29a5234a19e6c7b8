"""Scalers fitted on one range of the data and applied to all of it.

A fitted scaler is a small table, one row per series. It is joined without a
forced hint: Spark broadcasts it when its measured size allows and shuffles
(splitting skewed partitions) when it does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import array_mean, array_var_pop, let

STATS = ("mean", "std", "min", "max")
METHODS = ("standard", "minmax", "minmax_square", "minmax_m1p1", "standard_eps")
EPS = 1e-8


def fit_scaler(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Mean, population deviation, minimum and maximum per series and feature."""
    aggs = []
    for c in cols:
        aggs += [
            F.avg(c).alias(f"{c}__mean"),
            F.stddev_pop(c).alias(f"{c}__std"),
            F.min(c).alias(f"{c}__min"),
            F.max(c).alias(f"{c}__max"),
        ]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def _nonzero(c: Column) -> Column:
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def _forward(c: str, method: str) -> Column:
    x = F.col(c)
    mean, std, lo, hi = (F.col(f"{c}__{s}") for s in STATS)
    if method == "standard":
        return (x - mean) / _nonzero(std)
    if method == "standard_eps":
        return (x - mean) / (std + EPS)
    if method == "minmax":
        return 2.0 * (x - lo) / _nonzero(hi - lo) - 1.0
    if method == "minmax_square":
        unit = (x - lo) / _nonzero(hi - lo)
        return unit * unit
    if method == "minmax_m1p1":
        return 2.0 * x / F.nullif(hi, F.lit(0.0)) - 1.0
    raise ValueError(f"unknown scaling method {method!r}")


def _backward(c: str, method: str) -> Column:
    x = F.col(c)
    mean, std, lo, hi = (F.col(f"{c}__{s}") for s in STATS)
    if method == "standard":
        return x * _nonzero(std) + mean
    if method == "standard_eps":
        return x * (std + EPS) + mean
    if method == "minmax":
        return (x + 1.0) / 2.0 * _nonzero(hi - lo) + lo
    if method == "minmax_square":
        return F.sqrt(x) * _nonzero(hi - lo) + lo
    if method == "minmax_m1p1":
        return (x + 1.0) / 2.0 * hi
    raise ValueError(f"unknown scaling method {method!r}")


def _with_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))  # keyless: one row


Methods = str | dict[str, str]
"""One method for all columns, or one per column."""


def _mapped(df: DataFrame, stats: DataFrame, cols: Sequence[str], method: Methods, keys: Sequence[str], fn) -> DataFrame:
    out = _with_stats(df, stats, keys)
    by_col = {c: method if isinstance(method, str) else method[c] for c in cols}
    return out.select(*[fn(c, by_col[c]).alias(c) if c in by_col else F.col(c) for c in df.columns])


def apply_scaler(
    df: DataFrame, stats: DataFrame, cols: Sequence[str], method: Methods, keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Scale all columns in one join with their fitted numbers."""
    return _mapped(df, stats, cols, method, keys, _forward)


def invert_scaler(
    df: DataFrame, stats: DataFrame, cols: Sequence[str], method: Methods, keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Back to the original unit, with the numbers used on the way out (``standard_eps``: deviation plus epsilon)."""
    return _mapped(df, stats, cols, method, keys, _backward)


def scale_splits(
    df: DataFrame,
    cols: Sequence[str],
    method: str = "standard",
    keys: Sequence[str] = ("series_id",),
    per_split: bool = False,
) -> DataFrame:
    """Fit on the rows of split ``train`` and apply everywhere; ``per_split`` fits each split on itself."""
    if per_split:
        stats = fit_scaler(df, cols, [*keys, "split"])
        return apply_scaler(df, stats, cols, method, [*keys, "split"])
    return apply_scaler(df, fit_scaler(df.where("split = 'train'"), cols, keys), cols, method, keys)


# -- scaling inside a window -------------------------------------------------------------------


def normalize_window(
    windows: DataFrame,
    col: str,
    eps: float = 1e-5,
    subtract_last: bool = False,
    non_norm: bool = False,
    weight: float | None = None,
    bias: float | None = None,
) -> DataFrame:
    """Remove level and scale of each window; both are kept as ``<col>_center`` and ``<col>_scale``."""
    a = F.col(col)
    center = F.element_at(a, -1) if subtract_last else array_mean(a)
    scale = F.sqrt(array_var_pop(a) + F.lit(eps))
    if non_norm:
        center, scale = F.lit(0.0), F.lit(1.0)
    kept = windows.withColumns({f"{col}_center": center, f"{col}_scale": scale})
    unit = let(_level(col), lambda s: F.transform(a, lambda v: (v - s["center"]) / s["scale"]))
    if weight is not None and not non_norm:
        unit = F.transform(unit, lambda v: v * F.lit(weight) + F.lit(bias or 0.0))
    return kept.withColumn(col, unit)


def denormalize_window(
    windows: DataFrame,
    col: str,
    like: str | None = None,
    weight: float | None = None,
    bias: float | None = None,
    eps: float = 1e-5,
) -> DataFrame:
    """Inverse of ``normalize_window``, also for a forecast of a window (``like`` names the window column)."""
    ref = like or col
    a = F.col(col)
    if weight is not None:
        a = F.transform(a, lambda v: (v - F.lit(bias or 0.0)) / F.lit(weight + eps * eps))
    return windows.withColumn(col, let(_level(ref), lambda s: F.transform(a, lambda v: v * s["scale"] + s["center"])))


def _level(col: str) -> Column:
    return F.struct(F.col(f"{col}_center").alias("center"), F.col(f"{col}_scale").alias("scale"))


def subtract_last(windows: DataFrame, col: str) -> DataFrame:
    kept = windows.withColumn(f"{col}_last", F.element_at(col, -1))
    return kept.withColumn(col, let(f"{col}_last", lambda last: F.transform(col, lambda v: v - last)))


def add_last(windows: DataFrame, col: str, like: str) -> DataFrame:
    return windows.withColumn(col, let(f"{like}_last", lambda last: F.transform(col, lambda v: v + last)))


def masked_stats(
    df: DataFrame, value: Column, observed: Column, keys: Sequence[str], eps: float = 1e-5
) -> DataFrame:
    """Mean and deviation over observed cells only; the deviation is around that mean."""
    seen = F.when(observed, value)
    return df.groupBy(*keys).agg(
        F.count(seen).alias("observed"),
        F.avg(seen).alias("mean"),
        F.sqrt(F.var_pop(seen) + F.lit(eps)).alias("std"),
    )
