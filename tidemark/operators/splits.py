"""Train / validation / test splits as a column, so one plan serves all three."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import series_lengths

SPLITS = ("train", "val", "test")


def _ranges(bounds: Sequence[tuple[str, Column, Column]], idx: str) -> Column:
    member = [F.when((F.col(idx) >= lo) & (F.col(idx) < hi), F.lit(name)) for name, lo, hi in bounds]
    return F.filter(F.array(*member), lambda s: s.isNotNull())


def split_borders(df: DataFrame, borders: Sequence[int], history: int = 0, idx: str = "idx") -> DataFrame:
    """Fixed borders; later splits start ``history`` rows early.

    A row inside the history of the next split appears once per split.
    """
    starts = [0, *borders[:-1]]
    bounds = [
        (name, F.lit(max(0, lo - (history if i else 0))), F.lit(hi))
        for i, (name, lo, hi) in enumerate(zip(SPLITS, starts, borders, strict=True))
    ]
    return df.withColumn("split", F.explode(_ranges(bounds, idx)))


def split_ratio(
    df: DataFrame,
    train: float = 0.7,
    test: float = 0.2,
    history: int = 0,
    keys: Sequence[str] = ("series_id",),
    idx: str = "idx",
) -> DataFrame:
    """Split by share of the rows of each series; floors as in ``int()``, validation gets the rest."""
    sizes = series_lengths(df, keys, "_n").select(
        *keys,
        F.col("_n"),
        F.floor(F.col("_n") * F.lit(train)).alias("_train"),
        F.floor(F.col("_n") * F.lit(test)).alias("_test"),
    )
    cut = F.col("_n") - F.col("_test")
    bounds = [
        ("train", F.lit(0), F.col("_train")),
        ("val", F.col("_train") - history, cut),
        ("test", cut - history, F.col("_n")),
    ]
    joined = df.join(sizes, list(keys))
    return joined.withColumn("split", F.explode(_ranges(bounds, idx))).drop("_n", "_train", "_test")


def split_train_valid(
    df: DataFrame, rate: float = 0.8, keys: Sequence[str] = ("series_id",), idx: str = "idx"
) -> DataFrame:
    """First share of the rows is train, the rest validation."""
    sizes = series_lengths(df, keys, "_n")
    share = F.when(F.col(idx) < F.floor(F.col("_n") * F.lit(rate)), "train").otherwise("val")
    return df.join(sizes, list(keys)).withColumn("split", share).drop("_n")


def split_rows(df: DataFrame, train_end: int = 400, val_end: int = 550, idx: str = "idx") -> DataFrame:
    """Split at fixed row numbers."""
    return df.withColumn(
        "split",
        F.when(F.col(idx) < train_end, "train").when(F.col(idx) < val_end, "val").otherwise("test"),
    )


def rows_between(df: DataFrame, start: int, count: int, idx: str = "idx") -> DataFrame:
    """A row range of each series."""
    return df.where((F.col(idx) >= start) & (F.col(idx) < start + count))
