"""Sliding windows and the reshapes built on them.

Rows are gathered once per block of ``rows`` consecutive positions plus a halo
of ``length - 1``; windows are then cut out of the block's arrays without a
further shuffle. A row is therefore shuffled about once however small the
stride is, and one long series is spread over as many tasks as it has blocks.

A window row holds ``w_no``, ``w_start``, ``w_end`` (exclusive) and one array per
column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let, slices

KEYS = ("series_id",)


def block_arrays(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], idx: str, rows: int, after: int
) -> DataFrame:
    """One row per block with ordered arrays of the block's rows and ``after`` more."""
    lo = F.greatest(F.floor((F.col(idx) - F.lit(after)) / F.lit(rows)), F.lit(0)).cast("long")
    hi = F.floor(F.col(idx) / F.lit(rows)).cast("long")
    copied = df.select(*keys, idx, *cols, F.explode(F.sequence(lo, hi)).alias("_block"))
    gathered = copied.groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list(F.struct(F.col(idx).alias("_i"), *cols))).alias("_rows")
    )
    return gathered.select(*keys, "_block", F.col("_rows._i").alias("_i"), *[F.col(f"_rows.{c}").alias(c) for c in cols])


def sliding_windows(
    df: DataFrame,
    length: int,
    stride: int | Column = 1,
    cols: Sequence[str] = ("x",),
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
    rows: int | None = None,
) -> DataFrame:
    """All complete windows starting at 0, stride, 2*stride, ... of each series.

    ``idx`` must be dense per series. Series shorter than ``length`` give no window. The stride
    may be an expression over the keys.
    """
    if length < 1 or (isinstance(stride, int) and stride < 1):
        raise ValueError("length and stride must be positive")
    stride = F.lit(stride) if isinstance(stride, int) else stride
    rows = rows or max(512, 4 * length)
    blocks = block_arrays(df, cols, keys, idx, rows, length - 1)
    base = F.col("_block") * F.lit(rows)
    first = (F.ceil(base / stride) * stride).cast("long")
    last = F.least(base + F.lit(rows - 1), F.element_at("_i", -1) - F.lit(length - 1)).cast("long")
    starts = blocks.where(first <= last).withColumn(
        "w_start", F.explode(F.sequence(first, last, stride.cast("long")))
    )
    offset = (F.col("w_start") - F.element_at("_i", 1) + 1).cast("int")
    return starts.select(
        *keys,
        F.floor(F.col("w_start") / stride).cast("long").alias("w_no"),
        F.col("w_start"),
        (F.col("w_start") + F.lit(length)).alias("w_end"),
        *[F.slice(F.col(c), offset, F.lit(length)).alias(c) for c in cols],
    )


def forecast_windows(
    df: DataFrame,
    seq_len: int,
    label_len: int,
    pred_len: int,
    cols: Sequence[str] = ("x",),
    marks: Sequence[str] = (),
    stride: int = 1,
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
) -> DataFrame:
    """Input and target arrays: input ``[i, i+seq)``, target ``[i+seq-label, i+seq+pred)``.

    Marks (calendar columns) are cut the same way into ``<m>_x`` and ``<m>_y``.
    """
    wins = sliding_windows(df, seq_len + pred_len, stride, [*cols, *marks], keys, idx)
    parts = []
    for c in (*cols, *marks):
        parts.append(F.slice(c, 1, seq_len).alias(f"{c}_x"))
        parts.append(F.slice(c, seq_len - label_len + 1, label_len + pred_len).alias(f"{c}_y"))
    return wins.select(*keys, "w_no", "w_start", *parts)


def default_stride(split: str, length: int, slide: int | None = None) -> int:
    """Half a window for train and validation (or ``slide``), a whole window for test."""
    return length if split == "test" else (slide or length // 2)


def windows_by_split(
    df: DataFrame, length: int, slide: int | None = None, cols: Sequence[str] = ("x",), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Windows inside each split with the stride of that split; ``idx`` is dense per split."""
    known = df.where(F.col("split").isin("train", "val", "test"))
    stride = F.when(F.col("split") == "test", default_stride("test", length, slide)).otherwise(default_stride("train", length, slide))
    return sliding_windows(known, length, stride, cols, [*keys, "split"])


# -- gap checks ---------------------------------------------------------------------------------


def keep_regular(windows: DataFrame, step_seconds: int, ts: str = "ts") -> DataFrame:
    """Keep windows whose last minus first timestamp equals (points - 1) steps."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    span = micros(F.element_at(ts, -1)) - micros(F.element_at(ts, 1))
    return windows.where(span == (F.size(ts) - 1).cast("long") * F.lit(step_seconds * 1_000_000))


def keep_regular_index(windows: DataFrame, position: str) -> DataFrame:
    """The same check on an integer position column."""
    return windows.where(F.element_at(position, -1) - F.element_at(position, 1) == F.size(position) - 1)


def reconstruction_rows(
    df: DataFrame,
    length: int,
    stride: int,
    col: str = "x",
    label: str | None = None,
    ts: str = "ts",
    step_seconds: int | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Rows whose answer is the window itself; ``attack`` holds every label of the window."""
    wins = sliding_windows(df, length, stride, [c for c in (col, ts, label) if c], keys)
    if step_seconds is not None:
        wins = keep_regular(wins, step_seconds, ts)
    attack = F.col(label) if label else F.transform(col, lambda _: F.lit(0))
    return wins.select(*keys, "w_start", F.col(col).alias("given"), F.col(ts), F.col(col).alias("answer"), attack.alias("attack"))


def prediction_rows(
    df: DataFrame,
    length: int,
    stride: int,
    col: str = "x",
    label: str | None = None,
    ts: str = "ts",
    step_seconds: int | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Rows that predict the last of ``length`` points from the ones before.

    A window needs one more point after it (starts run over n - length), and the
    gap check covers that point too.
    """
    wins = sliding_windows(df, length + 1, stride, [c for c in (col, ts, label) if c], keys)
    if step_seconds is not None:
        wins = keep_regular(wins, step_seconds, ts)
    attack = F.element_at(label, length) if label else F.lit(0)
    return wins.select(
        *keys,
        "w_start",
        F.slice(col, 1, length - 1).alias("given"),
        F.slice(ts, 1, length).alias(ts),
        F.element_at(col, length).alias("answer"),
        attack.alias("attack"),
    )


def window_labels(windows: DataFrame, label: str = "label", keys: Sequence[str] = KEYS) -> DataFrame:
    """Labels of all window points, flattened to one row per window and point."""
    return windows.select(*keys, "w_no", "w_start", F.posexplode(label).alias("pos", label))


def centre_label(windows: DataFrame, label: str = "label", name: str = "centre") -> DataFrame:
    """Label at the centre point of each window."""
    return windows.withColumn(name, F.element_at(F.col(label), (F.floor(F.size(label) / 2) + 1).cast("int")))


def windows_to_points(
    windows: DataFrame, score: str, keys: Sequence[str] = KEYS, how: str = "mean", name: str = "score"
) -> DataFrame:
    """Per-point scores from per-window score arrays; overlaps are reduced by ``how``."""
    reducers = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}
    points = windows.select(*keys, "w_start", F.posexplode(score).alias("_pos", "_score"))
    return points.groupBy(*keys, (F.col("w_start") + F.col("_pos")).alias("idx")).agg(reducers[how]("_score").alias(name))


# -- reshapes inside a window ---------------------------------------------------------------------


def decoder_seed(windows: DataFrame, col: str, label_len: int, pred_len: int, name: str = "seed") -> DataFrame:
    """The first ``label_len`` target values followed by zeros."""
    return windows.withColumn(name, F.concat(F.slice(col, 1, label_len), F.array_repeat(F.lit(0.0), pred_len)))


def patches(windows: DataFrame, col: str, size: int, step: int, pad: int | None = None, name: str = "patches") -> DataFrame:
    """Patches of a window after repeating its last value ``pad`` times (default: one step)."""
    pad = step if pad is None else pad
    padded = F.concat(F.col(col), F.array_repeat(F.element_at(col, -1), pad))
    return windows.withColumn(name, slices(padded, size, step))


def segments(windows: DataFrame, col: str, size: int, pad_front: bool = False, name: str = "segments") -> DataFrame:
    """Non-overlapping segments; ``pad_front`` repeats the first value up to a multiple of ``size``."""
    a = F.col(col)
    if pad_front:
        missing = ((F.lit(size) - F.size(a) % F.lit(size)) % F.lit(size)).cast("int")
        a = F.concat(F.array_repeat(F.element_at(a, 1), missing), a)
    return windows.withColumn(name, slices(a, size, size))


def fold_period(windows: DataFrame, col: str, period: Column | int, name: str = "folded") -> DataFrame:
    """Rows of one period each, zero padded at the end."""
    p = (F.lit(period) if isinstance(period, int) else period).cast("int")
    missing = lambda x: ((p - F.size(x) % p) % p).cast("int")
    padded = let(col, lambda x: F.concat(x, F.array_repeat(F.lit(0.0), missing(x))))
    return windows.withColumn(name, slices(padded, p, p))


def even_odd(windows: DataFrame, col: str) -> DataFrame:
    """Points at even and at odd positions."""
    return windows.withColumns(
        {
            f"{col}_even": F.filter(col, lambda _, i: i % 2 == 0),
            f"{col}_odd": F.filter(col, lambda _, i: i % 2 == 1),
        }
    )


def chunked_views(windows: DataFrame, col: str, size: int) -> DataFrame:
    """Continuous chunks of ``size`` points, and interval samples that take every (n/size)-th point."""
    steps = F.sequence(F.lit(0), F.lit(size - 1))

    def interval(x: Column) -> Column:
        count = (F.size(x) / F.lit(size)).cast("int")
        pick = lambda j: F.transform(steps, lambda k: F.element_at(x, (k * count + j + 1).cast("int")))
        return F.transform(F.sequence(F.lit(0), count - 1), pick)

    return windows.withColumns({f"{col}_continuous": slices(F.col(col), size, size), f"{col}_interval": let(col, interval)})


def lookbacks(windows: DataFrame, col: str, pred_len: int, multiples: Sequence[int]) -> DataFrame:
    """The last m * pred_len points of a window for several m."""
    return windows.withColumns(
        {f"{col}_back_{m}": F.slice(F.col(col), F.lit(-m * pred_len), F.lit(m * pred_len)) for m in multiples}
    )


def multi_scale(
    df: DataFrame,
    factor: int,
    levels: int,
    col: str = "x",
    how: str = "avg",
    marks: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
) -> DataFrame:
    """Down-sampled copies of each series: level k aggregates complete blocks of factor^k points.

    All levels are produced by one aggregation; level 0 is the series itself.
    Marks are taken from the first point of each block.
    """
    if how not in ("avg", "max"):
        raise ValueError("how must be 'avg' or 'max'")
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    copied = df.select(*keys, idx, col, *marks, level).withColumn("_size", F.pow(F.lit(factor), F.col("level")).cast("long"))
    reducer = F.avg if how == "avg" else F.max
    pooled = copied.groupBy(*keys, "level", F.floor(F.col(idx) / F.col("_size")).cast("long").alias("pos")).agg(
        reducer(col).alias(col),
        *[F.min_by(m, idx).alias(m) for m in marks],
        F.count(F.lit(1)).alias("_count"),
        F.first("_size").alias("_size"),
    )
    return pooled.where("_count = _size").drop("_count", "_size")


def pack_features(windows: DataFrame, cols: Sequence[str], name: str = "w") -> DataFrame:
    """Feature arrays side by side as one array of arrays (feature, time)."""
    return windows.withColumn(name, F.array(*cols))
