"""Forecast error metrics over rows of (pred, true), global or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import with_halo

# Guards against division by zero.
FLOOR = 1e-6
EPS = 1e-5


def mae(pred: str = "pred", true: str = "true") -> Column:
    return F.avg(F.abs(F.col(true) - F.col(pred)))


def mse(pred: str = "pred", true: str = "true") -> Column:
    return F.avg(_square(F.col(true) - F.col(pred)))


def rmse(pred: str = "pred", true: str = "true") -> Column:
    return F.sqrt(mse(pred, true))


def mape(pred: str = "pred", true: str = "true") -> Column:
    """Denominator is the larger of |true| and a small floor."""
    return F.avg(F.abs(F.col(true) - F.col(pred)) / F.greatest(F.abs(F.col(true)), F.lit(FLOOR)))


def mape_signed(pred: str = "pred", true: str = "true") -> Column:
    """Denominator is true plus a small constant, sign kept."""
    return F.avg(F.abs((F.col(pred) - F.col(true)) / (F.col(true) + F.lit(EPS))))


def mspe(pred: str = "pred", true: str = "true") -> Column:
    return F.avg(_square((F.col(true) - F.col(pred)) / F.greatest(F.abs(F.col(true)), F.lit(FLOOR))))


def mspe_signed(pred: str = "pred", true: str = "true") -> Column:
    return F.avg(_square((F.col(pred) - F.col(true)) / (F.col(true) + F.lit(EPS))))


def _square(c: Column) -> Column:
    return c * c


def rse(pred: str = "pred", true: str = "true", eps: float = 0.0) -> Column:
    """Root squared error relative to the spread of the true values.

    The spread is n times the population variance, which Spark merges from
    partial (count, mean, M2) states, so one pass is enough.
    """
    spread = F.sqrt(F.var_pop(true) * F.count(true))
    return F.try_divide(F.sqrt(F.sum(_square(F.col(true) - F.col(pred)))), spread + F.lit(eps))


def basic_metrics(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", true: str = "true") -> DataFrame:
    """All basic metrics in one aggregation."""
    aggs = {
        "mae": mae(pred, true),
        "mse": mse(pred, true),
        "rmse": rmse(pred, true),
        "mape": mape(pred, true),
        "mspe": mspe(pred, true),
        "rse": rse(pred, true),
    }
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def signed_metrics(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", true: str = "true") -> DataFrame:
    """MAE, MSE, RMSE with the signed-denominator percentage errors."""
    aggs = {
        "mae": mae(pred, true),
        "mse": mse(pred, true),
        "rmse": rmse(pred, true),
        "mape": mape_signed(pred, true),
        "mspe": mspe_signed(pred, true),
    }
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def corr(
    df: DataFrame, cells: Sequence[str], by: Sequence[str] = (), pred: str = "pred", true: str = "true", eps: float = 0.0
) -> DataFrame:
    """Mean over cells of sum(dt*dp) / sqrt(sum(dt^2 * dp^2)). Not Pearson's coefficient.

    A cell is one position of the sample (for example horizon and feature); means
    are taken per cell over all samples, the result is averaged per ``by``.
    """
    keys = [*by, *[c for c in cells if c not in by]]
    means = df.groupBy(*keys).agg(F.avg(pred).alias("_mp"), F.avg(true).alias("_mt"))
    centred = df.join(means, keys)
    dt, dp = F.col(true) - F.col("_mt"), F.col(pred) - F.col("_mp")
    per_cell = centred.groupBy(*keys).agg(
        F.try_divide(F.sum(dt * dp), F.sqrt(F.sum(_square(dt) * _square(dp))) + F.lit(eps)).alias("_c")
    )
    return per_cell.groupBy(*by).agg(F.avg("_c").alias("corr"))


def masked_mape(pred: str = "pred", true: str = "true", mask: str = "mask") -> Column:
    """Mean of |pred - true| * mask / true, a zero denominator counts as zero."""
    weight = F.coalesce(F.col(mask) / F.nullif(F.col(true), F.lit(0.0)), F.lit(0.0))
    return F.avg(F.abs((F.col(pred) - F.col(true)) * weight))


def smape(pred: str = "pred", true: str = "true", mask: str = "mask") -> Column:
    """200 * mean of |pred - true| / (|pred| + |true|) * mask."""
    ratio = F.abs(F.col(true) - F.col(pred)) / F.nullif(F.abs(F.col(pred)) + F.abs(F.col(true)), F.lit(0.0))
    return F.lit(200.0) * F.avg(F.coalesce(ratio, F.lit(0.0)) * F.col(mask))


def seasonal_naive_error(
    history: DataFrame, freq: int, col: str = "x", keys: Sequence[str] = ("series_id",), idx: str = "idx"
) -> DataFrame:
    """Mean absolute difference of each series to itself ``freq`` steps earlier."""
    haloed = with_halo(history, idx, max(4096, 8 * freq), freq, 0)
    spec = Window.partitionBy(*keys, "_block").orderBy(idx)
    lagged = haloed.withColumn("_lag", F.lag(col, freq).over(spec)).where("_own")
    return lagged.groupBy(*keys).agg(F.avg(F.abs(F.col(col) - F.col("_lag"))).alias("naive"))


def mase(
    forecasts: DataFrame,
    history: DataFrame,
    freq: int,
    col: str = "x",
    keys: Sequence[str] = ("series_id",),
    pred: str = "pred",
    true: str = "true",
    mask: str = "mask",
) -> DataFrame:
    """Mean over forecasts of |error| scaled by the seasonal-naive error of the history."""
    scale = seasonal_naive_error(history, freq, col, keys)
    weight = F.coalesce(F.col(mask) / F.nullif(F.col("naive"), F.lit(0.0)), F.lit(0.0))
    errors = forecasts.join(scale, list(keys))
    return errors.agg(F.avg(F.abs(F.col(true) - F.col(pred)) * weight).alias("mase"))


def criterion(name: str, pred: str = "pred", true: str = "true", delta: float = 1.0) -> Column:
    """Training criterion used as a metric: ``mse``, ``mae`` or ``huber``."""
    if name == "mse":
        return mse(pred, true)
    if name == "mae":
        return mae(pred, true)
    if name == "huber":
        e = F.abs(F.col(true) - F.col(pred))
        return F.avg(F.when(e <= delta, e * e / 2.0).otherwise(F.lit(delta) * (e - F.lit(delta / 2.0))))
    raise ValueError(f"unknown criterion {name!r}")


def mean_of_batches(df: DataFrame, batch: str, metrics: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Metric per batch, then the plain mean over batches."""
    per_batch = df.groupBy(*by, batch).agg(*[c.alias(n) for n, c in metrics.items()])
    return per_batch.groupBy(*by).agg(*[F.avg(n).alias(n) for n in metrics])


def accuracy(pred: str = "pred", true: str = "true") -> Column:
    return F.avg(F.when(F.col(pred) == F.col(true), 1.0).otherwise(0.0))
