"""Statistical forecasts of windows and series.

These are closed-form substitutes for trained networks: linear maps of the
(decomposed) window, harmonics, damped trends and linear dynamics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arrays import array_mean, dot, let, pin
from tidemark.functions.fourier import DOUBLES
from tidemark.operators.decompose import decompose_window, exponential_smoothing, growth
from tidemark.operators.spectral import harmonic_curve, harmonics

KEYS = ("series_id",)


def unfitted_linear(windows: DataFrame, pred_len: int, kernel: int = 25, col: str = "x", name: str = "pred") -> DataFrame:
    """Trend and seasonal parts mapped with equal weights 1/L: every step is the sum of both means."""
    split = decompose_window(windows, kernel, col)
    level = array_mean(F.col("seasonal")) + array_mean(F.col("trend"))
    return split.withColumn(name, F.array_repeat(level, pred_len)).drop("trend", "seasonal")


@dataclass(frozen=True)
class LinearModel:
    """Weights (inputs + 1, horizon) of a direct linear forecast; the last row is the bias."""

    weights: np.ndarray
    kernel: int | None
    length: int


def _average_matrix(length: int, kernel: int) -> np.ndarray:
    """Matrix of the edge-padded centred moving average of a window."""
    half = (kernel - 1) // 2
    out = np.zeros((length, length))
    for i in range(length):
        for j in range(i - half, i + half + 1):
            out[i, min(max(j, 0), length - 1)] += 1.0 / kernel
    return out


def _design(x: np.ndarray, kernel: int | None) -> np.ndarray:
    ones = np.ones((len(x), 1))
    if kernel is None:
        return np.hstack([x, ones])
    trend = x @ _average_matrix(x.shape[1], kernel).T
    return np.hstack([x - trend, trend, ones])


def fit_linear(
    windows: DataFrame, length: int, pred_len: int, kernel: int | None = None, ridge: float = 1e-3, x: str = "x_x", y: str = "x_y"
) -> LinearModel:
    """Ridge fit of all horizons at once, shared by all series.

    Each task adds up its normal equations and emits them once; the sums are
    merged by an aggregation. Only the merged matrices, whose size depends on
    the window length alone, reach the driver. The last ``pred_len`` values of ``y`` are the targets.
    """
    d = (2 * length if kernel else length) + 1

    def normal_equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d + pred_len))
        for batch in batches:
            if len(batch):
                a = _design(np.stack(batch["x"].to_numpy()), kernel)
                b = np.stack(batch["y"].to_numpy())[:, -pred_len:]
                total += a.T @ np.hstack([a, b])
        yield pd.DataFrame({"values": [total.ravel()]})

    pairs = windows.select(F.col(x).alias("x"), F.col(y).alias("y"))
    parts = pairs.mapInPandas(normal_equations, T.StructType([T.StructField("values", DOUBLES)]))
    sums = parts.select(F.posexplode("values").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"))
    rows = sums.toPandas().sort_values("pos")["v"].to_numpy().reshape(d, d + pred_len)
    gram, target = rows[:, :d], rows[:, d:]
    penalty = (ridge + 1e-9 * np.trace(gram) / d) * np.eye(d)
    penalty[-1, -1] = 0.0  # the bias is free
    return LinearModel(np.linalg.solve(gram + penalty, target), kernel, length)


def linear_forecast(windows: DataFrame, model: LinearModel, col: str = "x", name: str = "pred") -> DataFrame:
    """Matrix product of each window with the fitted weights, one product per Arrow batch."""
    weights, kernel = model.weights, model.kernel

    @F.pandas_udf(DOUBLES)
    def predict(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(_design(np.stack(x.to_numpy()), kernel) @ weights))

    return pin(windows, col).withColumn(name, predict(col))


def harmonic_forecast(windows: DataFrame, length: int, pred_len: int, k: int, col: str = "x", name: str = "pred") -> DataFrame:
    """The strongest harmonics continued beyond the window, around the window mean."""
    curve = harmonic_curve(harmonics(windows, length, k, col), length, length + pred_len, name)
    return curve.withColumn(name, let(array_mean(F.col(col)), lambda m: F.transform(name, lambda v: v + m))).drop("harmonics")


def damped_trend_forecast(
    df: DataFrame,
    alpha: float,
    beta: float,
    damping: float,
    pred_len: int,
    col: str = "x",
    v0: float = 0.0,
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
) -> DataFrame:
    """Level and growth smoothed over the whole series, then level + growth * sum of damping powers."""
    grown = growth(df, beta, v0, 0.0, col, keys, idx)
    smooth = exponential_smoothing(grown, alpha, v0, col, "growth", keys, idx, "level")
    last = smooth.groupBy(*keys).agg(F.max_by(F.struct("level", "growth", idx), idx).alias("_l"))
    steps = [sum(damping**i for i in range(1, h + 1)) for h in range(1, pred_len + 1)]
    weights = F.array(*[F.lit(float(s)) for s in steps])
    out = last.select(*keys, F.col(f"_l.{idx}").alias("last_idx"), "_l.level", "_l.growth", F.posexplode(weights).alias("h", "_w"))
    return out.select(*keys, "last_idx", (F.col("h") + 1).alias("h"), (F.col("level") + F.col("growth") * F.col("_w")).alias("pred"))


def take_steps(windows: DataFrame, num_steps: int, col: str = "pred") -> DataFrame:
    """The first steps of a longer horizon."""
    return windows.withColumn(col, F.slice(col, 1, num_steps))


def named_steps(windows: DataFrame, col: str = "pred", keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per step, named t+1, t+2, ..."""
    out = windows.select(*keys, "w_start", F.posexplode(col).alias("_h", "pred"))
    return out.select(*keys, "w_start", F.concat(F.lit("t+"), F.col("_h") + 1).alias("step"), "pred")


# -- linear dynamics --------------------------------------------------------------------------------

TRANSITION = T.StructType([T.StructField("k", DOUBLES), T.StructField("powers", T.ArrayType(DOUBLES))])


def triangular(df: DataFrame, left: Sequence[Column], right: Sequence[Column], name: str) -> DataFrame:
    """Adds ``name``: array<array<double>>, the rows of R and Q'Y of the left columns' QR, by modified Gram-Schmidt.

    The right columns lose their part along each direction as it is found, so the result has
    the accuracy of an orthogonal factorisation. A column that depends on earlier ones has a zero row.
    """
    state = F.struct(F.array(*left, *right).alias("v"), F.array().cast("array<array<double>>").alias("r"))
    out = pin(df.withColumn(name, state), name)
    for a in range(len(left)):
        out = pin(out.withColumn(name, let(F.col(name), _orthogonal_step(a))), name)
    return out.withColumn(name, F.col(name)["r"])


def _orthogonal_step(a: int) -> Callable[[Column], Column]:
    """Take the direction of column a out of all later columns; their parts along it are one more row of R."""

    def step(s: Column) -> Column:
        own = s["v"][a]
        unit = let(F.sqrt(dot(own, own)), lambda n: F.transform(own, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

        def project(q: Column) -> Column:
            def less(r: Column) -> Column:
                without = lambda v, c: F.zip_with(v, q, lambda x, y: x - c * y)
                rest = F.transform(s["v"], lambda v, b: F.when(b <= a, v).otherwise(let(F.get(r, b), lambda c: without(v, c))))
                return F.struct(rest.alias("v"), F.concat(s["r"], F.array(r)).alias("r"))

            return let(F.transform(s["v"], lambda v, b: F.when(b < a, F.lit(0.0)).otherwise(dot(q, v))), less)

        return let(unit, project)

    return step


def linear_dynamics(
    windows: DataFrame, cols: Sequence[str], pred_len: int, multi_step: bool = False, name: str = "dynamics"
) -> DataFrame:
    """One-step transition K of each window by least squares, its reconstruction and roll-forward.

    The result is a struct (rec, pred) of arrays (feature, time). With Z the window's
    rows, K is the least-squares solution of X K = Y for X all rows but the last and Y all but the first; of
    several solutions it is the smallest. ``rec`` is the first row and X K. ``pred`` is
    the last row times K, K**2, ...; with ``multi_step`` the last pred_len rows times
    K**pred_len, or, beyond the window's length n, all rows times K**n, K**2n, ... A
    matrix that is not finite is replaced by identity.

    The factorisation and all applications of matrices are Spark expressions; only the
    solve of the small triangular system and its powers are done per Arrow batch.
    """
    size = len(cols)
    n = F.size(cols[0])
    rows, after = {c: F.slice(c, 1, n - 1) for c in cols}, {c: F.slice(c, 2, n - 1) for c in cols}

    @F.pandas_udf(TRANSITION)
    def solve(g: pd.Series, length: pd.Series) -> pd.DataFrame:
        eye = np.eye(size)
        sound = lambda m: m if np.isfinite(m).all() else eye
        ks, powers = [], []
        for a, m in zip(g, length, strict=True):
            r = np.array([list(v) for v in a], float).reshape(size, 2 * size)
            k = np.linalg.pinv(r[:, :size], rcond=1e-13) @ r[:, size:] if np.isfinite(r).all() else eye
            if not multi_step:
                steps = range(1, pred_len + 1)
            else:
                steps = [pred_len] if pred_len <= m else range(m, pred_len + m, m)
            ks.append(sound(k).reshape(-1))
            powers.append([sound(np.linalg.matrix_power(k, s)).reshape(-1) for s in steps])
        return pd.DataFrame({"k": ks, "powers": powers})

    packed = triangular(windows.withColumn("_n", n), [rows[c] for c in cols], [after[c] for c in cols], "_g")
    solved = pin(packed.withColumn("_t", solve.asNondeterministic()("_g", "_n")), "_t")

    def moved(at: Column, matrix: Column, to: int) -> Column:
        """Feature ``to`` of row ``at`` times a matrix."""
        return sum((F.get(c, at) * F.get(matrix, F.lit(i * size + to)) for i, c in enumerate(cols)), F.lit(0.0))

    def over(first: Column, last: Column, matrix: Column, to: int) -> Column:
        some = F.sequence(first.cast("int"), last.cast("int"))
        return F.when(last >= first, F.transform(some, lambda t: moved(t, matrix, to))).otherwise(F.array().cast("array<double>"))

    size_of = F.col("_n")
    powers = F.col("_t.powers")
    rec = [F.concat(F.slice(c, 1, 1), over(F.lit(0), size_of - 2, F.col("_t.k"), i)) for i, c in enumerate(cols)]

    def ahead(to: int) -> Column:
        if not multi_step:
            return F.transform(powers, lambda m: moved(size_of - 1, m, to))
        first = F.greatest(size_of - pred_len, F.lit(0))
        return F.slice(F.flatten(F.transform(powers, lambda m: over(first, size_of - 1, m, to))), 1, pred_len)

    pred = [ahead(i) for i in range(size)]
    out = solved.withColumn(name, F.struct(F.array(*rec).alias("rec"), F.array(*pred).alias("pred")))
    return out.drop("_g", "_n", "_t")
