"""Column roles, cleaning and the series contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import CHUNK, add_index, fill_nearest, series_lengths, with_chunk


def discover_features(df: DataFrame, ts: str | None = "ts", keys: Sequence[str] = ("series_id",)) -> list[str]:
    """Names of all columns that are neither the timestamp nor a key."""
    skip = {*keys, *([ts] if ts else [])}
    return [c for c in df.columns if c not in skip]


def select_features(
    df: DataFrame, mode: str, target: str, ts: str = "ts", keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Feature mode: ``M`` all to all, ``S`` target to target, ``MS`` all to target.

    In mode ``MS`` the target is placed last and also exposed as ``y``.
    """
    features = discover_features(df, ts, keys)
    if target not in features:
        raise ValueError(f"target {target!r} is not a feature column")
    if mode == "M":
        return df.select(*keys, ts, *features)
    if mode == "S":
        return df.select(*keys, ts, target)
    if mode == "MS":
        rest = [c for c in features if c != target]
        return df.select(*keys, ts, *rest, target, F.col(target).alias("y"))
    raise ValueError(f"unknown feature mode {mode!r}")


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in any of the columns."""
    return df.dropna("any", subset=list(cols) if cols else None)


def cast_features(df: DataFrame, cols: Sequence[str], dtype: str = "double") -> DataFrame:
    return df.withColumns({c: F.col(c).cast(dtype) for c in cols})


def order_position(
    df: DataFrame, keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("ts",), chunk: Column | int | None = None
) -> DataFrame:
    """Time order as a dense position; no global sort is needed to carry the order."""
    return add_index(df, keys, order, chunk)


def fill_gaps_in_time(
    df: DataFrame, seconds: int, cols: Sequence[str], ts: str = "ts", keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Put every series on its full time grid; missing steps get null features.

    The grid is generated per occupied day-sized span and joined on (key, step),
    so a long series is generated by many tasks.
    """
    keys = list(keys)
    step = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
    stepped = df.withColumn("_step", step)
    span = 1 << 16
    limits = stepped.groupBy(*keys).agg(F.min("_step").alias("_lo"), F.max("_step").alias("_hi"))
    pieces = limits.withColumn("_piece", F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.lit(span)))).repartition(
        *keys, "_piece"
    )
    grid = pieces.select(
        *keys,
        F.explode(F.sequence(F.col("_piece"), F.least(F.col("_piece") + span - 1, F.col("_hi")))).alias("_step"),
    )
    joined = grid.join(stepped.drop(ts), [*keys, "_step"], "left")
    rebuilt = F.timestamp_micros(F.col("_step") * F.lit(seconds * 1_000_000)).cast(dict(df.dtypes)[ts])
    return joined.select(*keys, rebuilt.alias(ts), *cols)


def fill_forward_backward(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ts",),
    chunk: Column | int | None = None,
) -> DataFrame:
    """Forward fill, then backward fill what is still missing at the start."""
    return fill_nearest(with_chunk(df, order, chunk), keys, order, cols, levels=1 if isinstance(chunk, Column) else 0).drop(CHUNK)


class SchemaError(ValueError):
    """The frame does not meet the series contract."""


def validate_schema(
    df: DataFrame,
    features: Sequence[str],
    ts: str = "ts",
    keys: Sequence[str] = ("series_id",),
    width: int | None = None,
) -> DataFrame:
    """Check names, order and width against ``df.schema`` without running a job."""
    missing = [c for c in (*keys, ts, *features) if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    present = [c for c in df.columns if c in set(features)]
    if present != list(features):
        raise SchemaError(f"feature order is {present}, expected {list(features)}")
    if width is not None and width != len(features):
        raise SchemaError(f"{len(features)} features, expected {width}")
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
    for name, dtype in df.select(*features).dtypes:
        if not dtype.startswith(numeric):
            raise SchemaError(f"feature {name!r} has type {dtype}")
    return df.select(*keys, ts, *features)


def length_report(df: DataFrame, window: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Per series: row count and whether one full window fits. Short series are reported, not failed."""
    return series_lengths(df, keys).withColumn("enough", F.col("n") >= F.lit(window))


def binary_label(df: DataFrame, col: str, normal: str | None = None, name: str = "label") -> DataFrame:
    """Label as 0/1: text compares with the normal word, numbers with zero."""
    hit = F.col(col) != F.lit(normal) if normal is not None else F.col(col) > 0
    return df.withColumn(name, F.when(hit, 1).otherwise(0))


def label_column(df: DataFrame, preferred: str = "attack") -> str:
    """The preferred label column, else the second column."""
    return preferred if preferred in df.columns else df.columns[1]


def attach_labels(df: DataFrame, labels: DataFrame, on: Sequence[str] = ("series_id", "ts")) -> DataFrame:
    """Labels joined on their keys. Nulls are dropped after the join, so rows stay aligned."""
    return df.join(labels, list(on), "inner")


def split_roles(
    df: DataFrame, static: Sequence[str], observed: Sequence[str], known: Sequence[str], keys: Sequence[str], ts: str
) -> DataFrame:
    """Pack columns into static, observed and known-ahead roles."""
    pack = lambda cols: F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(*keys, ts, pack(static).alias("static"), pack(observed).alias("observed"), pack(known).alias("known"))
