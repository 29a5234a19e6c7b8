"""Plugging a model into window scoring.

A model is any function ``fn(windows: ndarray[batch, length, features]) -> ndarray``. It
is created once per task by ``load()`` and fed Arrow batches of windows; the
result is stored in one array column whose shape the task name decides. Windows and
results pass as flat buffers, with no Python object for a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fourier import DOUBLES

Model = Callable[[np.ndarray], np.ndarray]

# Output type of each task: forecasts are (feature, step), scores (point), classes (class).
TASKS = {
    "forecast": T.ArrayType(DOUBLES),
    "impute": T.ArrayType(DOUBLES),
    "reconstruct": T.ArrayType(DOUBLES),
    "score": DOUBLES,
    "classify": DOUBLES,
}


class ShapeError(ValueError):
    """Windows or model output do not have the expected shape."""


def stack_windows(batch: pd.DataFrame, cols: Sequence[str], length: int | None) -> np.ndarray:
    """Windows of a batch as (batch, length, features)."""
    stacked = np.stack([np.stack(batch[c].to_numpy()) for c in cols], axis=-1).astype(float)
    if length is not None and stacked.shape[1] != length:
        raise ShapeError(f"window length is {stacked.shape[1]}, expected {length}")
    return stacked


def _flat(column: pa.Array) -> np.ndarray | None:
    """Windows of an Arrow column as (batch, length), or None where they are no plain numbers of one length."""
    if not pa.types.is_list(column.type) or not (pa.types.is_floating(column.type.value_type) or pa.types.is_integer(column.type.value_type)):
        return None
    steps = np.diff(column.offsets.to_numpy())
    if column.null_count or (steps != steps[0]).any():
        return None
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), steps[0])


def arrow_windows(batch: pa.RecordBatch, cols: Sequence[str], length: int | None) -> np.ndarray:
    """Windows of an Arrow batch as (batch, length, features)."""
    parts = [_flat(batch.column(c)) for c in cols]
    if any(p is None or p.shape != parts[0].shape for p in parts):
        return stack_windows(batch.select(list(cols)).to_pandas(), cols, length)
    if length is not None and parts[0].shape[1] != length:
        raise ShapeError(f"window length is {parts[0].shape[1]}, expected {length}")
    return np.stack(parts, axis=-1)


def _lists(values: pa.Array, size: int, n: int) -> pa.Array:
    """``n`` lists of ``size`` values each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int64) * size, pa.int32()), values)


def result_lists(result: np.ndarray, matrix: bool) -> pa.Array:
    """Model output, one array a window, or one per feature and window where the task gives a matrix."""
    n = len(result)
    shaped = result.transpose(0, 2, 1) if matrix else result.reshape(n, -1)
    flat = pa.array(np.ascontiguousarray(shaped, dtype=float).reshape(-1), pa.float64(), from_pandas=True)
    inner = _lists(flat, shaped.shape[-1], int(np.prod(shaped.shape[:-1])))
    return _lists(inner, shaped.shape[1], n) if matrix else inner


def score_windows(
    windows: DataFrame,
    load: Callable[[], Model],
    task: str = "score",
    cols: Sequence[str] = ("x",),
    keep: Sequence[str] = ("series_id", "w_start"),
    length: int | None = None,
    name: str = "out",
    errors: str = "fail",
) -> DataFrame:
    """Run a model over all windows.

    ``load`` is called once per task, so weights are read once and not per batch.
    With ``errors='column'`` the windows of a failing batch are run one by one, and
    only those that fail have null output and a message in ``error``; otherwise the
    job fails.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}")
    if errors not in ("fail", "column"):
        raise ValueError("errors must be 'fail' or 'column'")
    matrix = isinstance(TASKS[task].elementType, T.ArrayType)
    fields = [windows.schema[c] for c in keep] + [T.StructField(name, TASKS[task])]
    if errors == "column":
        fields.append(T.StructField("error", T.StringType()))

    kept, made = list(keep), [f.name for f in fields[len(keep) :]]

    def apply(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        result = np.asarray(model(arrow_windows(batch, cols, length)))
        if len(result) != batch.num_rows:
            raise ShapeError(f"model returned {len(result)} rows for {batch.num_rows} windows")
        out = [*batch.select(kept).columns, result_lists(result, matrix)]
        if errors == "column":
            out.append(pa.nulls(batch.num_rows, pa.string()))
        return pa.RecordBatch.from_arrays(out, names=[*kept, *made])

    def unscored(batch: pa.RecordBatch, message: str) -> pa.RecordBatch:
        empty = pa.nulls(batch.num_rows, pa.list_(pa.list_(pa.float64())) if matrix else pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.select(kept).columns, empty, pa.array([message] * batch.num_rows, pa.string())], names=[*kept, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            if not batch.num_rows:
                continue
            try:
                yield apply(model, batch)
            except Exception:
                if errors == "fail":
                    raise
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    try:
                        yield apply(model, one)
                    except Exception as e:
                        yield unscored(one, f"{type(e).__name__}: {e}")

    return windows.select(*keep, *cols).mapInArrow(run, T.StructType(fields))


def describe_windows(windows: DataFrame, length: int, stride: int, task: str) -> DataFrame:
    """Window bounds and settings next to each result."""
    return windows.withColumns(
        {
            "w_end": F.col("w_start") + F.lit(length),
            "window_size": F.lit(length),
            "stride": F.lit(stride),
            "task": F.lit(task),
        }
    )
