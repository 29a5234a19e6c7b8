"""Random masking, imputation and its quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import uniform
from tidemark.operators.cleaning import fill_forward_backward
from tidemark.operators.decompose import moving_average
from tidemark.operators.ordering import idx_chunk

KEYS = ("series_id",)


def random_mask(
    df: DataFrame, cols: Sequence[str], rate: float = 0.25, seed: int = 0, keys: Sequence[str] = KEYS, idx: str = "idx"
) -> DataFrame:
    """Hide cells at random: adds ``<c>_mask`` (1 = kept, 0 = hidden) and ``<c>_seen``.

    The draw depends on seed, series, position and feature only, so a rerun or
    another partitioning hides the same cells.
    """
    out = df
    for c in cols:
        kept = F.when(uniform(seed, c, *[F.col(k) for k in (*keys, idx)]) < rate, 0).otherwise(1)
        out = out.withColumn(f"{c}_mask", kept).withColumn(f"{c}_seen", F.when(F.col(f"{c}_mask") == 1, F.col(c)))
    return out


def impute(
    df: DataFrame,
    col: str,
    method: str = "fill",
    kernel: int = 25,
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
    name: str = "imputed",
) -> DataFrame:
    """Fill the nulls of ``col``.

    ``identity`` returns the input, ``fill`` carries neighbours forward then backward,
    ``mean`` takes the mean of the observed points of the series, ``trend`` the centred
    moving average of the filled series. Observed values never change.
    """
    if method == "identity":
        return df.withColumn(name, F.col(col))
    if method == "mean":
        means = df.groupBy(*keys).agg(F.avg(col).alias("_mean"))
        return df.join(means, list(keys)).withColumn(name, F.coalesce(col, "_mean")).drop("_mean")
    filled = fill_forward_backward(df.withColumn(name, F.col(col)), [name], keys, [idx], idx_chunk(idx, 4096))
    if method == "fill":
        return filled
    if method == "trend":
        smooth = moving_average(filled, [kernel], name, keys, idx)
        return smooth.withColumn(name, F.coalesce(F.col(col), F.col(f"ma_{kernel}"))).drop(f"ma_{kernel}")
    raise ValueError(f"unknown method {method!r}")


def imputation_error(df: DataFrame, true: str, imputed: str, mask: Column, by: Sequence[str] = ()) -> DataFrame:
    """MAE and MSE over hidden cells only."""
    gap = F.when(mask == 0, F.col(true) - F.col(imputed))
    return df.groupBy(*by).agg(
        F.count(gap).alias("cells"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse")
    )
