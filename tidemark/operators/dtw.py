"""Warping distances and paths of window pairs.

The pairs come from joins (see ``mates``): their number is linear in the number of
windows. Each Arrow batch of pairs is solved in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import warping
from tidemark.functions.arrays import pin

STEPS = T.StructType([T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("j", T.ArrayType(T.IntegerType()))])
ROWS = 1024
"""Pairs of an Arrow batch that are unpacked at once."""


def as_matrix(window) -> np.ndarray:
    """(channel, time) lists as (time, channel)."""
    return np.stack([np.asarray(c, dtype=float) for c in window]).T


def solve_pairs(a: pd.Series, b: pd.Series, fn: Callable[[np.ndarray, np.ndarray], Sequence]) -> list:
    """Apply a batch solver to pairs grouped by their lengths, some rows at a time; null partners give None."""
    out: list = [None] * len(a)
    for at in range(0, len(a), ROWS):
        u, v = a.iloc[at : at + ROWS], b.iloc[at : at + ROWS]
        known = [i for i, (x, y) in enumerate(zip(u, v, strict=True)) if present(x) and present(y)]
        solved = warping.grouped([as_matrix(u.iloc[i]) for i in known], [as_matrix(v.iloc[i]) for i in known], fn)
        for i, value in zip(known, solved, strict=True):
            out[at + i] = value
    return out


def present(window) -> bool:
    """False for a missing partner."""
    return window is not None and all(c is not None for c in window)


def _packed(pairs: DataFrame, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    return pin(pairs.withColumns({"_a": F.array(*a), "_b": F.array(*b)}), "_a", "_b")


def step_columns(paths: Sequence) -> pd.DataFrame:
    """Paths as one array of i and one of j per pair, so no step is a Python object."""
    return pd.DataFrame({c: pd.Series([None if p is None else np.asarray(p[k], np.int32) for p in paths], dtype=object) for k, c in enumerate("ij")})


def zipped(steps: Column) -> Column:
    """The path as array of (i, j)."""
    return F.arrays_zip(steps["i"].alias("i"), steps["j"].alias("j"))


def packed_distance(
    df: DataFrame, a: str, b: str, steps: str, window: int | None, shape: bool = False, name: str = "distance"
) -> DataFrame:
    """Distance of the windows (channel, time) in two columns."""

    @F.pandas_udf(T.DoubleType())
    def run(u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(solve_pairs(u, v, lambda x, y: warping.dtw_distances(x, y, steps, window, shape)), dtype=float)

    return pin(pin(df, a, b).withColumn(name, run.asNondeterministic()(a, b)), name)


def packed_path(df: DataFrame, a: str, b: str, steps: str, window: int | None, shape: bool = False, name: str = "path") -> DataFrame:
    """Warping path, an array of (i, j), of the windows in two columns."""

    @F.pandas_udf(STEPS)
    def run(u: pd.Series, v: pd.Series) -> pd.DataFrame:
        return step_columns(solve_pairs(u, v, lambda x, y: warping.dtw_paths(x, y, steps, window, shape)))

    solved = pin(pin(df, a, b).withColumn(name, run.asNondeterministic()(a, b)), name)
    return pin(solved.withColumn(name, zipped(F.col(name))), name)


def dtw_distance(
    pairs: DataFrame,
    a: Sequence[str] = ("x",),
    b: Sequence[str] = ("mate_x",),
    steps: str = "asymmetric",
    window: int | None = None,
    shape: bool = False,
    name: str = "distance",
) -> DataFrame:
    """Distance of each pair; ``shape`` compares local neighbourhoods instead of points."""
    packed = pairs.withColumns({"_a": F.array(*a), "_b": F.array(*b)})
    return packed_distance(packed, "_a", "_b", steps, window, shape, name).drop("_a", "_b")


def dtw_path(
    pairs: DataFrame,
    a: Sequence[str] = ("x",),
    b: Sequence[str] = ("mate_x",),
    steps: str = "asymmetric",
    window: int | None = None,
    shape: bool = False,
    name: str = "path",
) -> DataFrame:
    """Warping path of each pair as array of (i, j)."""
    packed = pairs.withColumns({"_a": F.array(*a), "_b": F.array(*b)})
    return packed_path(packed, "_a", "_b", steps, window, shape, name).drop("_a", "_b")


def weighted_dtw_distance(
    pairs: DataFrame,
    a: Sequence[str] = ("x",),
    b: Sequence[str] = ("mate_x",),
    metric: str = "euclidean",
    warp: int = 1,
    window: int | None = None,
    weight: float = 1.0,
    name: str = "distance",
    path: str | None = None,
) -> DataFrame:
    """Distance with longer moves and a weight on off-diagonal ones; optionally the path."""

    def solve(x: np.ndarray, y: np.ndarray) -> list:
        tables = warping.weighted_dtw(x, y, metric, warp, window, weight)
        walked = warping.traces(tables, "symmetric") if path else [None] * len(tables)
        return list(zip(tables[:, -1, -1].tolist(), walked, strict=True))

    result = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("p", STEPS)] if path else [T.StructField("d", T.DoubleType())])

    @F.pandas_udf(result)
    def run(u: pd.Series, v: pd.Series) -> pd.DataFrame:
        solved = [s or (None, None) for s in solve_pairs(u, v, solve)]
        out = pd.DataFrame({"d": pd.Series([d for d, _ in solved], dtype=float)})
        if path:
            out["p"] = step_columns([p for _, p in solved]).to_dict("records")
        return out

    out = pin(_packed(pairs, a, b).withColumn("_r", run.asNondeterministic()("_a", "_b")), "_r")
    cols = {name: F.col("_r.d"), **({path: zipped(F.col("_r.p"))} if path else {})}
    return out.withColumns(cols).drop("_a", "_b", "_r")


def sample_medoids(
    gathered: DataFrame, mates: str = "mates", steps: str = "symmetric", window: int | None = None, id_col: str = "window_id"
) -> DataFrame:
    """id, medoid, near: the sample's window with the smallest sum of distances, and (distance, place) of all from it.

    Spark lists the pairs inside each sample, at most its size squared; only
    distances are solved on Arrow batches, and only they are shuffled. Symmetric steps
    give both directions of a pair the same distance, so one is solved.
    """
    first = gathered.select(id_col, mates, F.posexplode(mates).alias("p", "_u"))
    pairs = first.select(id_col, "p", "_u", F.posexplode(mates).alias("q", "_v"))
    if steps == "symmetric":
        pairs = pairs.where("p <= q")
    solved = packed_distance(pairs, "_u", "_v", steps, window, name="d").select(id_col, "p", "q", "d")
    if steps == "symmetric":
        there, back = F.struct("p", "q", "d"), F.struct(F.col("q").alias("p"), F.col("p").alias("q"), "d")
        both = F.when(F.col("p") < F.col("q"), F.array(there, back)).otherwise(F.array(there))
        solved = solved.select(id_col, F.inline(both))
    each = solved.groupBy(id_col, "p").agg(F.sum("d").alias("total"), F.array_sort(F.collect_list(F.struct("d", "q"))).alias("near"))
    best = each.groupBy(id_col).agg(F.min_by(F.struct("p", "near"), F.struct("total", "p")).alias("b"))
    return best.select(id_col, F.col("b.p").alias("medoid"), F.col("b.near").alias("near"))


def medoid(
    gathered: DataFrame,
    mates: str = "mates",
    steps: str = "symmetric",
    window: int | None = None,
    name: str = "medoid",
    id_col: str = "window_id",
) -> DataFrame:
    """Medoid of each row's sample of windows, the sample in order of distance to it, and those distances."""
    found = sample_medoids(gathered, mates, steps, window, id_col)
    packed = F.when(
        F.col("near").isNotNull(),
        F.struct(F.col("_m").alias("medoid"), F.col("near")["q"].alias("order"), F.col("near")["d"].alias("distances")),
    )
    joined = gathered.join(found.withColumnRenamed("medoid", "_m"), id_col, "left")
    return joined.withColumn(name, packed).drop("_m", "near")
