"""Trend / seasonal decomposition, smoothing, filtering and wavelets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import array_sum, let, slices
from tidemark.operators.ordering import lag_by_index, with_halo

KEYS = ("series_id",)
CHUNK_ROWS = 1024
GROUP_DIGITS = 60.0


def _odd(kernel: int) -> int:
    if kernel < 1 or kernel % 2 == 0:
        raise ValueError("kernel must be odd")
    return (kernel - 1) // 2


def _centred_mean(col: str, kernel: int, spec, idx: str) -> Column:
    """Mean over a centred frame; rows beyond an edge count as copies of the edge value.

    A null inside the frame is left out of sum and count; a frame of nulls gives null.
    """
    half = _odd(kernel)
    frame = spec.rowsBetween(-half, half)
    before = F.greatest(F.lit(half) - F.col(idx), F.lit(0))
    after = F.lit(kernel) - F.count(F.lit(1)).over(frame) - before
    first, last = F.first(col).over(frame), F.last(col).over(frame)
    total = F.coalesce(F.sum(col).over(frame), F.lit(0.0)) + F.coalesce(before * first, F.lit(0.0)) + F.coalesce(after * last, F.lit(0.0))
    present = F.count(col).over(frame) + F.when(first.isNotNull(), before).otherwise(0) + F.when(last.isNotNull(), after).otherwise(0)
    return total / F.nullif(present, F.lit(0))


def moving_average(
    df: DataFrame,
    kernels: Sequence[int],
    col: str = "x",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
    rows: int | None = None,
) -> DataFrame:
    """Centred moving averages, one column ``ma_<k>`` per odd kernel, edges padded with edge values."""
    half = max(_odd(k) for k in kernels)
    rows = rows or max(4096, 8 * half)
    haloed = with_halo(df, idx, rows, half, half)
    spec = Window.partitionBy(*keys, "_block").orderBy(idx)
    out = haloed.select("*", *[_centred_mean(col, k, spec, idx).alias(f"ma_{k}") for k in kernels])
    return out.where("_own").drop("_block", "_own")


def decompose(
    df: DataFrame, kernel: int = 25, col: str = "x", keys: Sequence[str] = KEYS, idx: str = "idx", rows: int | None = None
) -> DataFrame:
    """Trend (moving average) and seasonal remainder."""
    return decompose_multi(df, [kernel], col, keys, idx, rows)


def decompose_multi(
    df: DataFrame,
    kernels: Sequence[int],
    col: str = "x",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
    rows: int | None = None,
) -> DataFrame:
    """Trend as the mean of several moving averages."""
    averaged = moving_average(df, kernels, col, keys, idx, rows)
    names = [f"ma_{k}" for k in kernels]
    trend = sum((F.col(n) for n in names[1:]), F.col(names[0])) / F.lit(float(len(names)))
    return averaged.withColumn("trend", trend).withColumn("seasonal", F.col(col) - F.col("trend")).drop(*names)


def decompose_window(windows: DataFrame, kernel: int, col: str = "x") -> DataFrame:
    """The same split inside each window, with the window's own edges."""
    half = _odd(kernel)
    a = F.col(col)
    padded = F.concat(
        F.array_repeat(F.element_at(a, 1), half), a, F.array_repeat(F.element_at(a, -1), half)
    )
    trend = F.transform(slices(padded, kernel, 1), lambda w: array_sum(w) / F.lit(kernel))
    out = windows.withColumn("trend", trend)
    return out.withColumn("seasonal", F.zip_with(a, F.col("trend"), lambda x, t: x - t))


def exponential_smoothing(
    df: DataFrame,
    alpha: float,
    v0: float = 0.0,
    col: str = "x",
    aux: str | None = None,
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
    name: str = "smoothed",
) -> DataFrame:
    """y_t = a^(t+1) v0 + sum_j (1-a) a^(t-j) x_j, optionally plus sum_j a^(t-j+1) aux_j.

    Rows are cut into chunks of bounded size and chunks into groups over which
    the weights fall by about GROUP_DIGITS powers of ten, so sums of scaled terms
    stay in range. A chunk's end is a sum of its rows; its start gathers the earlier
    chunks of its group by a running sum, and the ends of earlier groups by one
    equi-join, for as many groups as a double can hold the weight of. Nothing but
    weights that are zero in double precision is left out.
    """
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie between 0 and 1")
    span = max(1, math.ceil(GROUP_DIGITS / -math.log10(alpha)))
    rows = min(CHUNK_ROWS, span)
    per = math.ceil(span / rows)
    term = F.col(col) * F.lit(1.0 - alpha)
    if aux:
        term = term + F.col(aux) * F.lit(alpha)
    a = F.lit(alpha)
    keys = list(keys)
    cut = df.withColumn("_block", F.floor(F.col(idx) / F.lit(rows)).cast("long")).withColumn(
        "_at", (F.col(idx) - F.col("_block") * F.lit(rows)).cast("double")
    )
    ends = (
        cut.groupBy(*keys, "_block")
        .agg(F.sum(term * F.pow(a, F.lit(float(rows - 1)) - F.col("_at"))).alias("_end"))
        .withColumn("_group", F.floor(F.col("_block") / F.lit(per)).cast("long"))
        .withColumn("_k", (F.col("_block") - F.col("_group") * F.lit(per)).cast("double"))
    )
    # earlier chunks of the group: a ** (rows * (k - 1 - j)) each
    decay = alpha**rows
    before = Window.partitionBy(*keys, "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.sum(F.col("_end") * F.pow(F.lit(decay), -F.col("_k"))).over(before) * F.pow(F.lit(decay), F.col("_k") - 1.0)
    # earlier groups: the state at a group's end, carried on while its weight is above zero
    whole = ends.groupBy(*keys, "_group").agg(F.sum(F.col("_end") * F.pow(F.lit(decay), F.lit(float(per - 1)) - F.col("_k"))).alias("_sum"))
    reach = [alpha ** float(rows * per * i) for i in range(8)]
    reach = [w for w in reach if w > 0.0]
    carried = (
        whole.select(*keys, "_group", "_sum", F.posexplode(F.array(*[F.lit(w) for w in reach])).alias("_i", "_w"))
        .groupBy(*keys, (F.col("_group") + F.col("_i") + 1).alias("_group"))
        .agg(F.sum(F.col("_sum") * F.col("_w")).alias("_older"))
    )
    starts = (
        ends.withColumn("_inside", F.coalesce(inside, F.lit(0.0)))
        .join(carried, [*keys, "_group"], "left")
        .select(*keys, "_block", (F.col("_inside") + F.coalesce("_older", F.lit(0.0)) * F.pow(F.lit(decay), F.col("_k"))).alias("_carry"))
    )
    spec = Window.partitionBy(*keys, "_block").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_local", F.sum(term * F.pow(a, -F.col("_at"))).over(spec) * F.pow(a, F.col("_at")))
    joined = local.join(starts, [*keys, "_block"], "left")
    value = (
        F.col("_local")
        + F.coalesce(F.col("_carry"), F.lit(0.0)) * F.pow(a, F.col("_at") + 1.0)
        + F.lit(v0) * F.pow(a, F.col(idx) + F.lit(1.0))
    )
    return joined.select(*df.columns, value.alias(name))


def growth(
    df: DataFrame,
    alpha: float,
    z0: float = 0.0,
    v0: float = 0.0,
    col: str = "x",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
) -> DataFrame:
    """First differences (against ``z0`` at the start), then smoothed; ``v0`` is the value before the first row."""
    diff = lag_by_index(
        df, {"diff": lambda w: F.col(col) - F.coalesce(F.lag(col).over(w), F.lit(z0))}, keys, idx
    )
    return exponential_smoothing(diff, alpha, v0, "diff", None, keys, idx, "growth")


def causal_filter(
    df: DataFrame,
    kernel: Sequence[float],
    col: str = "x",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
    name: str = "filtered",
) -> DataFrame:
    """Convolution with a fixed kernel; its last weight belongs to the current point, zeros before the start and for nulls."""
    size = len(kernel)
    haloed = with_halo(df, idx, max(4096, 8 * size), 0 + size - 1, 0)
    frame = Window.partitionBy(*keys, "_block").orderBy(idx).rowsBetween(-(size - 1), 0)
    weights = F.array(*[F.lit(float(k)) for k in kernel])
    got = haloed.withColumn("_past", F.collect_list(F.coalesce(F.col(col), F.lit(0.0))).over(frame)).where("_own")
    tail = F.slice(weights, F.lit(size + 1) - F.size("_past"), F.size("_past"))
    value = array_sum(F.zip_with(F.col("_past"), tail, lambda x, w: x * w))
    return got.select(*df.columns, value.alias(name))


# -- wavelets -------------------------------------------------------------------------------------


def haar(
    df: DataFrame, levels: int, col: str = "x", keys: Sequence[str] = KEYS, idx: str = "idx"
) -> DataFrame:
    """Multi-level Haar transform of whole series with zero padding.

    A level-j coefficient is a signed sum over 2^j neighbours, so all levels come
    from one aggregation. Output: ``band`` (``high_1`` ... ``high_J``, ``low_J``), ``pos``, ``coef``.
    """
    level = F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("_level")
    copied = df.select(*keys, idx, col, level)
    size = F.pow(F.lit(2.0), F.col("_level"))
    first_half = F.floor(F.col(idx) * 2 / size) % 2 == 0
    sums = copied.groupBy(*keys, "_level", F.floor(F.col(idx) / size).cast("long").alias("pos")).agg(
        F.sum(F.when(first_half, F.col(col)).otherwise(-F.col(col))).alias("_high"), F.sum(col).alias("_low")
    )
    norm = F.pow(F.lit(2.0), F.col("_level") / 2.0)
    high = F.struct(F.concat(F.lit("high_"), F.col("_level")).alias("band"), (F.col("_high") / norm).alias("coef"))
    low = F.when(
        F.col("_level") == levels,
        F.struct(F.concat(F.lit("low_"), F.col("_level")).alias("band"), (F.col("_low") / norm).alias("coef")),
    )
    bands = F.filter(F.array(high, low), lambda b: b.isNotNull())
    return sums.select(*keys, "pos", F.explode(bands).alias("_b")).select(*keys, "_b.band", "pos", "_b.coef")


def inverse_haar(
    coefs: DataFrame, keys: Sequence[str] = KEYS, lengths: DataFrame | None = None, name: str = "x"
) -> DataFrame:
    """Series from Haar coefficients; ``lengths`` (keys, n) cuts the zero padding at the end."""
    level = F.regexp_extract("band", r"_(\d+)$", 1).cast("int")
    size = F.pow(F.lit(2.0), level).cast("long")
    spread = coefs.select(
        *keys,
        "band",
        "coef",
        size.alias("_size"),
        F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), size - 1), lambda k: F.col("pos") * size + k)).alias(
            "_k", "idx"
        ),
    )
    minus = F.col("band").startswith("high") & (F.col("_k") * 2 >= F.col("_size"))
    part = F.when(minus, -F.col("coef")).otherwise(F.col("coef")) / F.sqrt(F.col("_size").cast("double"))
    points = spread.groupBy(*keys, "idx").agg(F.sum(part).alias(name))
    if lengths is not None:
        points = points.join(lengths, list(keys)).where("idx < n").drop("n")
    return points


# Haar (Daubechies 1) analysis filters.
HAAR_LOW = (math.sqrt(0.5), math.sqrt(0.5))
HAAR_HIGH = (-math.sqrt(0.5), math.sqrt(0.5))

# Names of the edge extension modes.
PAD_MODES = ("zero", "symmetric", "periodization", "constant", "reflect", "replicate", "periodic")


def _extend(a: Column, n: int, left: int, right: int, mode: str) -> Column:
    """``left`` + n + ``right`` points of an array of length n extended beyond its ends."""

    def source(i: int) -> int | None:
        if 0 <= i < n:
            return i
        if mode == "zero":
            return None
        if mode in ("constant", "replicate"):
            return 0 if i < 0 else n - 1
        if mode in ("periodic", "periodization"):
            return i % n
        if mode == "symmetric":
            j = i % (2 * n)
            return j if j < n else 2 * n - 1 - j
        j = i % max(1, 2 * n - 2)
        return j if j < n else 2 * n - 2 - j

    picks = [source(i) for i in range(-left, n + right)]
    return let(a, lambda x: F.array(*[F.lit(0.0) if p is None else F.element_at(x, p + 1) for p in picks]))


def _analysis(source: Column, taps: Sequence[float], size: int) -> Column:
    """Every second value of the padded window correlated with the reversed filter."""
    weights = F.array(*[F.lit(float(v)) for v in reversed(taps)])
    pairs = F.slice(slices(source, len(taps), 2), 1, size)
    return F.transform(pairs, lambda part: array_sum(F.zip_with(part, weights, lambda x, w: x * w)))


def wavelet_window(
    windows: DataFrame,
    length: int,
    levels: int,
    col: str = "x",
    mode: str = "zero",
    low: Sequence[float] = HAAR_LOW,
    high: Sequence[float] = HAAR_HIGH,
) -> DataFrame:
    """Discrete wavelet transform of window arrays of one length, any filter pair.

    Adds ``high_1`` ... ``high_J`` and ``low_J``.
    """
    if mode not in PAD_MODES:
        raise ValueError(f"unknown pad mode {mode!r}")
    taps = len(low)
    out, current, n = windows, F.col(col), length
    for j in range(1, levels + 1):
        if mode == "periodization":
            if n % 2:
                current = F.concat(current, F.array(F.element_at(current, -1)))
                n += 1
            size = n // 2
            left = taps // 2 - 1
            right = taps - 1 - left
        else:
            size = (n + taps - 1) // 2
            pad = 2 * (size - 1) - n + taps
            left, right = pad // 2, (pad + 1) // 2
        out = out.withColumn(f"_pad_{j}", _extend(current, n, left, right, mode))
        source = F.col(f"_pad_{j}")

        out = out.withColumns({f"high_{j}": _analysis(source, high, size), f"low_{j}": _analysis(source, low, size)})
        current, n = F.col(f"low_{j}"), size
    drop = [f"_pad_{j}" for j in range(1, levels + 1)] + [f"low_{j}" for j in range(1, levels)]
    return out.drop(*drop)


def _synthesis(low: Column, high: Column, g0: Column, g1: Column, taps: int):
    """Value at output position n from both bands and their synthesis filters."""

    def point(n: Column) -> Column:
        first = F.greatest(F.lit(0), F.floor(n / 2).cast("int"))
        last = F.least(F.size(high) - 1, F.floor((n + (taps - 2)) / 2).cast("int"))
        at = lambda k: (n + F.lit(taps - 1) - 2 * k).cast("int")
        return F.aggregate(
            F.sequence(first, last),
            F.lit(0.0),
            lambda acc, k: acc
            + F.element_at(low, k + 1) * F.element_at(g0, at(k))
            + F.element_at(high, k + 1) * F.element_at(g1, at(k)),
        )

    return point


def inverse_wavelet_window(
    windows: DataFrame,
    levels: int,
    name: str = "restored",
    low: Sequence[float] = tuple(reversed(HAAR_LOW)),
    high: Sequence[float] = tuple(reversed(HAAR_HIGH)),
) -> DataFrame:
    """Window arrays from their wavelet bands (all pad modes but periodization)."""
    taps = len(low)
    g0 = F.array(*[F.lit(float(v)) for v in low])
    g1 = F.array(*[F.lit(float(v)) for v in high])
    out = windows.withColumn(name, F.col(f"low_{levels}"))
    for j in range(levels, 0, -1):
        both = F.struct(F.slice(F.col(name), F.lit(1), F.size(f"high_{j}")).alias("low"), F.col(f"high_{j}").alias("high"))
        restore = lambda s: F.transform(
            F.sequence(F.lit(0), (2 * F.size(s["high"]) - F.lit(taps - 1)).cast("int")),
            _synthesis(s["low"], s["high"], g0, g1, taps),
        )
        out = out.withColumn(name, let(both, restore))
    return out
