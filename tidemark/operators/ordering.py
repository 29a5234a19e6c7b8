"""Order-dependent building blocks that never put a whole series in one task.

A window function partitioned by the series alone moves every row of a hot
series into one task. The functions here work in two levels instead: rows are
split into ordered chunks of a series, each chunk is scanned on its own, and
the small table of per-chunk totals carries state from one chunk to the next.

Four ways to cut a series into chunks, all order preserving:

* ``time_chunk``   fixed time width; bounded when the series lies on a grid
* ``range_chunk``  quantile ranges of the order column; a chunk then holds about
  1/n of *all* rows, whatever share one series has
* ``series_chunk`` one chunk for a series of few rows, quantile ranges for the others
* ``idx_chunk``    blocks of a dense index; bounded by construction
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
FAN = 128
"""Chunks of a level that make one chunk of the level above."""
OVERSPLIT = 4
"""Quantile chunks per shuffle partition, so uneven ones even out."""
LIGHT = -(1 << 61)
"""The chunk of a series that is not cut."""
LIGHT_ROWS = 1_000
"""A series of so many rows is never cut."""
PIECE_ROWS = 100
"""Heavy series are cut into chunks of so many rows at least, on average."""


def epoch_micros(col: Column | str) -> Column:
    """Microseconds since the epoch for date, timestamp and zone-less timestamp."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def time_chunk(ts: str, seconds: int) -> Column:
    """Chunk number of a timestamp for chunks of a fixed width."""
    return F.floor(epoch_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def idx_chunk(idx: str, rows: int) -> Column:
    """Chunk number of a dense index."""
    return F.floor(F.col(idx) / F.lit(rows)).cast("long")


def shuffle_width(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _number(df: DataFrame, col: str) -> Column | None:
    """Order-preserving number of a column, or None for types without one."""
    dtype = dict(df.dtypes)[col]
    if dtype.startswith(("timestamp", "date")):
        return epoch_micros(col).cast("double")
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return F.col(col).cast("double")
    return None


def _borders(df: DataFrame, number: Column, n: int) -> list[float]:
    name = "_value"
    probabilities = [i / n for i in range(1, n)]
    return df.select(number.alias(name)).approxQuantile(name, probabilities, max(1e-4, 1.0 / (8 * n)))


def _bucket(df: DataFrame, number: Column, borders: Sequence[float], name: str) -> DataFrame:
    splits = [-float("inf"), *(sorted(set(borders)) or [0.0]), float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="_value", outputCol=name, handleInvalid="keep")
    out = cutter.transform(df.withColumn("_value", number)).drop("_value")
    # a null sorts first, so it gets the chunk before all others
    return out.withColumn(name, F.coalesce(F.col(name).cast("long"), F.lit(-1).cast("long")))


def range_chunk(df: DataFrame, order: Sequence[str] | str, chunks: int | None = None, name: str = CHUNK) -> DataFrame:
    """Add a chunk number from quantile ranges of the order columns.

    The borders are a bounded set of numbers (one per chunk) taken from Spark's
    own quantile sketch, then fixed as literals, so every use of the chunk
    column in one plan agrees. Any borders give the same results; good borders
    only balance the work. A value so frequent that it spans several quantiles is
    cut further by the second order column (the tie breaker).
    """
    order = [order] if isinstance(order, str) else list(order)
    n = chunks or OVERSPLIT * shuffle_width(df)
    first = _number(df, order[0])
    if first is None:
        raise ValueError(f"column {order[0]!r} has no numeric order; give a chunk expression")
    borders = _borders(df, first, n)
    out = _bucket(df, first, borders, name)
    heavy = [v for v, times in Counter(borders).items() if times > 1]
    second = _number(df, order[1]) if len(order) > 1 else None
    if not heavy or second is None:
        return out
    tied = first.isin(heavy)
    inner = _bucket(out, second, _borders(df.where(tied), second, n), "_inner")
    # a heavy value opens its bucket: its rows come before all others of that bucket
    place = F.when(tied, F.col("_inner")).otherwise(F.lit(n + 1))
    return inner.withColumn(name, F.col(name) * F.lit(n + 2) + place).drop("_inner")


def with_chunk(df: DataFrame, order: Sequence[str] | str, chunk: Column | int | None, name: str = CHUNK) -> DataFrame:
    """Add the chunk column: an expression as given, else quantile ranges."""
    if isinstance(chunk, Column):
        return df.withColumn(name, F.coalesce(chunk, F.lit(-(1 << 62)).cast("long")))
    return range_chunk(df, order, chunk, name)


def series_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ``_rows``: the rows of each series."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def series_chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str], sizes: DataFrame | None = None, name: str = CHUNK) -> DataFrame:
    """Add a chunk number that leaves series of few rows whole (``LIGHT``) and cuts the others by ``range_chunk``.

    Cut at quantiles, short series fall apart into chunks of one row, and the table of chunk totals is as
    long as the data. A series is heavy when it has more than a quantile chunk's share of all
    rows, so there are at most as many heavy series as quantile chunks. They are cut into no more chunks than
    leave PIECE_ROWS rows to each on average. ``sizes`` are the ``series_sizes``, if known.
    """
    n = OVERSPLIT * shuffle_width(df)
    sizes = series_sizes(df, keys) if sizes is None else sizes
    total, most = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
    limit = max(LIGHT_ROWS, (total or 0) // n)
    if (most or 0) <= limit:
        return df.withColumn(name, F.lit(LIGHT))
    large = sizes.where(F.col("_rows") > limit)
    series, rows = large.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    heavy = F.broadcast(large.select(*keys))
    chunks = max(2, min(n, rows // (PIECE_ROWS * series)))
    cut = range_chunk(df.join(heavy, list(keys), "left_semi"), order, chunks, name)
    return cut.unionByName(df.join(heavy, list(keys), "left_anti").withColumn(name, F.lit(LIGHT)))


def totals_before(totals: DataFrame, keys: list[str], chunk: str, names: Sequence[str], levels: int) -> DataFrame:
    """keys, chunk, ``_off_<name>``: the sum of ``_sum_<name>`` over all earlier chunks of the key.

    With ``levels`` the chunk table is itself cut into chunks of FAN, whose totals are summed in the same
    way, so a task scans FAN rows of a level or what is left of them after the last one.
    """
    sums = lambda w: [F.coalesce(F.sum(f"_sum_{n}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n in names]
    if not levels:
        window = Window.partitionBy(*keys).orderBy(chunk)
        return totals.select(*keys, chunk, *[s.alias(f"_off_{n}") for s, n in zip(sums(window), names, strict=True)])
    up = f"{chunk}u"
    cut = totals.withColumn(up, F.floor(F.col(chunk) / FAN).cast("long"))
    above = cut.groupBy(*keys, up).agg(*[F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in names])
    carried = totals_before(above, keys, up, names, levels - 1).select(*keys, up, *[F.col(f"_off_{n}").alias(f"_up_{n}") for n in names])
    window = Window.partitionBy(*keys, up).orderBy(chunk)
    inner = cut.select(*keys, chunk, up, *[s.alias(f"_in_{n}") for s, n in zip(sums(window), names, strict=True)])
    return inner.join(carried, [*keys, up]).select(*keys, chunk, *[(F.col(f"_in_{n}") + F.col(f"_up_{n}")).alias(f"_off_{n}") for n in names])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: dict[str, Column],
    chunk: str = CHUNK,
    levels: int = 0,
    light: int | None = None,
) -> DataFrame:
    """Add inclusive running sums along ``order`` within ``keys``.

    ``order`` must be a total order within a chunk. The offset table has one row
    per (key, chunk); its own prefix sum therefore sees chunks, not data rows. Quantile chunks are
    few; where the number of chunks grows with a series, ``levels`` keeps that table's scan small too.
    Series whose only chunk is ``light`` take no part in that table.
    """
    keys = list(keys)
    names = list(sums)
    terms = df.select("*", *[c.alias(f"_term_{n}") for n, c in sums.items()])
    if light is not None:
        terms = terms.dropna(subset=keys)  # null keys join with no offset
    cut = terms if light is None else terms.where(F.col(chunk) != light)
    totals = cut.groupBy(*keys, chunk).agg(*[F.sum(f"_term_{n}").alias(f"_sum_{n}") for n in names])
    offsets = totals_before(totals, keys, chunk, names, levels)
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = terms.select(
        *df.columns, *[F.sum(f"_term_{n}").over(inside).alias(f"_run_{n}") for n in names]
    )
    return local.join(offsets, [*keys, chunk], "inner" if light is None else "left").select(
        *[c for c in df.columns if c not in names],
        *[(F.col(f"_run_{n}") + F.coalesce(f"_off_{n}", F.lit(0))).alias(n) for n in names],
    )


def add_index(
    df: DataFrame,
    keys: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ts",),
    chunk: Column | int | None = None,
    name: str = "idx",
) -> DataFrame:
    """Add a dense 0-based position per series, without a per-series sort task.

    ``order`` must be unique within a series (add a tie breaker if it is not).
    """
    whole = chunk is None and len(keys) > 0
    cut = series_chunk(df, keys, list(order)) if whole else with_chunk(df, order, chunk)
    levels = 1 if isinstance(chunk, Column) else 0
    out = running_totals(cut, keys, list(order), {name: F.lit(1).cast("long")}, levels=levels, light=LIGHT if whole else None)
    return out.withColumn(name, F.col(name) - 1).drop(CHUNK)


def edges_around(edges: DataFrame, keys: list[str], chunk: str, cols: Sequence[str], levels: int) -> DataFrame:
    """keys, chunk, ``_before_<c>`` and ``_after_<c>``: the nearest known value in earlier and in later chunks (``levels`` as in ``totals_before``)."""

    def nearest(window) -> list[Column]:
        before, after = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(1, Window.unboundedFollowing)
        return [
            *[F.last(f"_hi_{c}", ignorenulls=True).over(before).alias(f"_before_{c}") for c in cols],
            *[F.first(f"_lo_{c}", ignorenulls=True).over(after).alias(f"_after_{c}") for c in cols],
        ]

    if not levels:
        return edges.select(*keys, chunk, *nearest(Window.partitionBy(*keys).orderBy(chunk)))
    up = f"{chunk}u"
    cut = edges.withColumn(up, F.floor(F.col(chunk) / FAN).cast("long"))
    at = lambda c: F.when(F.col(c).isNotNull(), F.col(chunk))
    above = cut.groupBy(*keys, up).agg(
        *[F.max_by(f"_hi_{c}", at(f"_hi_{c}")).alias(f"_hi_{c}") for c in cols], *[F.min_by(f"_lo_{c}", at(f"_lo_{c}")).alias(f"_lo_{c}") for c in cols]
    )
    names = [f"_{side}_{c}" for side in ("before", "after") for c in cols]
    far = edges_around(above, keys, up, cols, levels - 1).select(*keys, up, *[F.col(n).alias(f"{n}_up") for n in names])
    near = cut.select(*keys, chunk, up, *nearest(Window.partitionBy(*keys, up).orderBy(chunk)))
    return near.join(far, [*keys, up]).select(*keys, chunk, *[F.coalesce(n, f"{n}_up").alias(n) for n in names])


def fill_nearest(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], chunk: str = CHUNK, levels: int = 0
) -> DataFrame:
    """Replace nulls by the nearest earlier non-null value of the series, else by the nearest later one.

    Both directions share one pass over the chunks and one join with the chunk edges.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    position = F.struct(*order)
    at = lambda c: F.when(F.col(c).isNotNull(), position)
    edges = df.groupBy(*keys, chunk).agg(
        *[F.max_by(c, at(c)).alias(f"_hi_{c}") for c in cols], *[F.min_by(c, at(c)).alias(f"_lo_{c}") for c in cols]
    )
    carried = edges_around(edges, keys, chunk, cols, levels)
    back, ahead = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    local = df.select(
        "*",
        *[F.last(c, ignorenulls=True).over(back).alias(f"_back_{c}") for c in cols],
        *[F.first(c, ignorenulls=True).over(ahead).alias(f"_ahead_{c}") for c in cols],
    )
    filled = lambda c: F.coalesce(f"_back_{c}", f"_before_{c}", f"_ahead_{c}", f"_after_{c}").alias(c)
    return local.join(carried, [*keys, chunk]).select(*[filled(c) if c in cols else F.col(c) for c in df.columns])


def with_halo(df: DataFrame, idx: str, rows: int, before: int, after: int, block: str = "_block") -> DataFrame:
    """Copy rows near a block border to the neighbouring blocks.

    Adds ``block`` and ``_own`` (true for the one copy in the row's own block). A
    row frame of at most ``before`` preceding and ``after`` following rows is then
    exact for the owned rows inside ``partitionBy(keys, block)``.
    """
    lo = F.floor((F.col(idx) - F.lit(after)) / F.lit(rows)).cast("long")
    hi = F.floor((F.col(idx) + F.lit(before)) / F.lit(rows)).cast("long")
    own = idx_chunk(idx, rows)
    return df.withColumn(block, F.explode(F.sequence(lo, hi))).withColumn("_own", F.col(block) == own)


def lag_by_index(
    df: DataFrame,
    cols: dict[str, Column],
    keys: Sequence[str] = ("series_id",),
    idx: str = "idx",
    rows: int = 4096,
) -> DataFrame:
    """Evaluate ``lag``-style expressions (one row back at most) per block.

    ``cols`` maps names to functions of a window spec, e.g.
    ``{"prev": lambda w: F.lag("x").over(w)}``.
    """
    haloed = with_halo(df, idx, rows, 1, 1)
    spec = Window.partitionBy(*keys, "_block").orderBy(idx)
    out = haloed.select("*", *[fn(spec).alias(n) for n, fn in cols.items()])
    return out.where("_own").drop("_block", "_own")


def series_lengths(df: DataFrame, keys: Sequence[str] = ("series_id",), name: str = "n") -> DataFrame:
    """Rows per series; partial aggregation keeps the shuffle at one row per task and series."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
