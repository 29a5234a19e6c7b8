"""Random partners for labelled windows without gathering a class in one place.

Windows are placed in a seeded hash order inside their class. The hash range
cuts the class into even chunks, so positions come from a two-level count and a
class holding a third of all rows is still spread over many tasks. A partner is
then found by an equi-join on a unique position; the number of joined rows is
the number of windows times the requested partners.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import PRIME, cell, integer
from tidemark.operators.ordering import add_index, shuffle_width

BITS = 12  # 4096 hash ranges per class


def positions(df: DataFrame, id_col: str, label: str, seed: int) -> DataFrame:
    """Add ``_pos`` (place in the class), ``_n`` (class size), ``_start`` (rows in earlier classes), ``_all``."""
    hashed = df.withColumn("_h", cell(seed, F.col(id_col)))
    placed = add_index(hashed, [label], ["_h", id_col], F.shiftright("_h", PRIME.bit_length() - BITS), "_pos").drop("_h")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(label)  # one row per class
    classes = sizes.withColumns(
        {
            "_start": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "_all": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    ).fillna(0, ["_start"])
    return placed.join(classes, label)


def _spread(k: int, pool: Column, start: Column) -> Column:
    """min(k, pool) distinct places of a pool: a drawn start and even steps from it."""
    count = F.least(F.lit(k).cast("long"), pool)
    step = F.greatest(F.floor(pool / count), F.lit(1))
    steps = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda j: (start + j * step) % pool)
    return F.when(pool > 0, steps).otherwise(F.array().cast("array<bigint>"))


def with_mates(
    df: DataFrame,
    k: int = 1,
    id_col: str = "window_id",
    label: str = "label",
    cols: Sequence[str] = ("x",),
    seed: int = 0,
    other_class: bool = False,
    include_self: bool = False,
) -> DataFrame:
    """Up to k partners of each window: ``mate_no``, ``mate_id`` and ``mate_<col>``.

    Partners share the class (never the window itself unless ``include_self``) or, with
    ``other_class``, come from any other class. Windows without a partner keep
    one row with null partner columns.
    """
    placed = positions(df, id_col, label, seed)
    n, pos = F.col("_n"), F.col("_pos")
    if other_class:
        pool = F.col("_all") - n
        start = integer(0, pool, seed, "other", F.col(id_col))
        skip = lambda p: F.when(p < F.col("_start"), p).otherwise(p + n)
        places = F.transform(_spread(k, pool, start), skip)
    elif include_self:
        start = integer(0, n, seed, "any", F.col(id_col))
        places = F.transform(_spread(k, n, start), lambda p: p + F.col("_start"))
    else:
        pool = n - 1
        start = integer(0, pool, seed, "same", F.col(id_col))
        places = F.transform(_spread(k, pool, start), lambda p: (pos + 1 + p) % n + F.col("_start"))
    wanted = placed.withColumn("_places", places).select(
        *df.columns, F.posexplode_outer("_places").alias("mate_no", "_g")
    )
    offered = placed.select(
        (F.col("_start") + pos).alias("_g"), F.col(id_col).alias("mate_id"), *[F.col(c).alias(f"mate_{c}") for c in cols]
    )
    # a fixed number of partitions: the solvers behind this join are bound by compute, not bytes
    met = wanted.where("_g IS NOT NULL").repartition(shuffle_width(df), "_g").join(offered, "_g")
    # windows without a partner stay where they are: a null key would gather them in one task
    alone = wanted.where("_g IS NULL").select("*", *[F.lit(None).cast(offered.schema[c].dataType).alias(c) for c in offered.columns if c != "_g"])
    return met.unionByName(alone).drop("_g")


def gather_mates(
    pairs: DataFrame, id_col: str, cols: Sequence[str], own: Sequence[str], name: str = "mates"
) -> DataFrame:
    """One row per window with its partners (at most k) as array of (channel, time), ordered by draw."""
    packed = F.when(F.col("mate_id").isNotNull(), F.struct("mate_no", F.array(*[f"mate_{c}" for c in cols]).alias("w")))
    grouped = pairs.repartition(shuffle_width(pairs), id_col).groupBy(id_col).agg(
        *[F.first(c).alias(c) for c in own], F.array_sort(F.collect_list(packed)).alias("_m")
    )
    return grouped.withColumn(name, F.col("_m.w")).drop("_m")
