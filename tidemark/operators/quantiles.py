"""Exact quantiles by rank, without gathering the distinct values of a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import CHUNK, range_chunk, running_totals
from tidemark.session import staged


def exact_quantiles(
    df: DataFrame,
    probabilities: Sequence[float],
    col: str = "score",
    by: Sequence[str] = (),
    chunks: int | None = None,
    name: str = "quantiles",
) -> DataFrame:
    """Linear quantiles of each group as an array, one value per probability.

    Equal values are merged first; their cumulative counts (two-level running
    totals over ranges of the value) tell which value sits at which rank.
    """
    by = list(by)
    known = df.where(F.col(col).isNotNull())
    merged = staged(known.groupBy(*by, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    ranked = running_totals(range_chunk(merged, "_v", chunks), by, ["_v"], {"_upto": F.col("_c")}).drop(CHUNK)
    sizes = merged.groupBy(*by).agg(F.sum("_c").alias("_n"))
    joined = ranked.join(sizes, by) if by else ranked.crossJoin(F.broadcast(sizes))  # without groups: one row
    at = lambda rank: F.max(
        F.when((F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")), F.col("_v"))
    )
    values = []
    for p in probabilities:
        place = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        values.append(low + (high - low) * F.max(place - F.floor(place)))
    return joined.groupBy(*by).agg(F.array(*values).alias(name))
