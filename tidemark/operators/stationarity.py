"""Unit-root statistic of each series and feature.

The regression of the difference on a constant, the lagged level and at most
one lagged difference needs only sums of products, which one aggregation
delivers per series; the 2x2 or 3x3 systems are then solved in closed form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import with_halo

KEYS = ("series_id",)


def _moments(names: Sequence[str], use: Column, prefix: str) -> list[Column]:
    """Count, means and centred cross products, merged stably by Spark's covariance states."""
    pick = {n: F.when(use, F.col(n)) for n in names}
    out = [F.count(pick[names[0]]).alias(f"{prefix}n")]
    for i, a in enumerate(names):
        for b in names[i:]:
            out.append((F.covar_pop(pick[a], pick[b]) * F.count(pick[a])).alias(f"{prefix}{a}{b}"))
    return out


# a constant or very short series has no statistic: null instead of an error
_ratio = F.try_divide


def _fit0(p: str) -> tuple[Column, Column]:
    """(residual sum, t value of the level) without a lagged difference."""
    s = lambda a: F.col(f"{p}{a}")
    beta = _ratio(s("yd"), s("yy"))
    rss = s("dd") - beta * s("yd")
    t = _ratio(beta, F.sqrt(_ratio(_ratio(rss, s("n") - 2), s("yy"))))
    return rss, t


def _fit1(p: str) -> tuple[Column, Column]:
    """The same with one lagged difference."""
    s = lambda a: F.col(f"{p}{a}")
    det = s("yy") * s("ll") - s("yl") * s("yl")
    beta = _ratio(s("ll") * s("yd") - s("yl") * s("ld"), det)
    gamma = _ratio(s("yy") * s("ld") - s("yl") * s("yd"), det)
    rss = s("dd") - beta * s("yd") - gamma * s("ld")
    t = _ratio(beta, F.sqrt(_ratio(_ratio(rss, s("n") - 3) * s("ll"), det)))
    return rss, t


def adf(
    df: DataFrame, cols: Sequence[str] = ("x",), lag: int | str = "aic", keys: Sequence[str] = KEYS, idx: str = "idx"
) -> DataFrame:
    """Augmented Dickey-Fuller t statistic with constant, at most one lag.

    ``lag`` is 0, 1 or ``aic``: then the lag with the smaller information criterion on
    the common sample is chosen and refitted on all rows it allows. Output: keys,
    ``feature``, ``lag``, ``n`` (rows used) and ``stat``.
    """
    feature = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols]))
    haloed = with_halo(df.select(*keys, idx, *cols), idx, 4096, 2, 0)
    rows = haloed.select(*keys, idx, "_block", "_own", feature.alias("_f")).select(*keys, idx, "_block", "_own", "_f.*")
    spec = Window.partitionBy(*keys, "feature", "_block").orderBy(idx)
    lagged = rows.withColumns({"y": F.lag("v").over(spec), "_two": F.lag("v", 2).over(spec)}).where("_own").select(
        *keys, "feature", "y", (F.col("v") - F.col("y")).alias("d"), (F.col("y") - F.col("_two")).alias("l")
    )
    has0, has1 = F.col("y").isNotNull(), F.col("l").isNotNull()
    sums = lagged.groupBy(*keys, "feature").agg(
        *_moments(["y", "d"], has0, "a_"), *_moments(["y", "d"], has1, "b_"), *_moments(["y", "l", "d"], has1, "c_")
    )
    # the product name of (l, d) and (y, l) follows the order above
    rss0, _ = _fit0("b_")
    rss1, stat1 = _fit1("c_")
    _, stat0 = _fit0("a_")
    n = F.col("b_n")
    aic0 = n * F.log(_ratio(rss0, n)) + 2 * 2
    aic1 = n * F.log(_ratio(rss1, n)) + 2 * 3
    if lag == "aic":
        chosen = F.when(aic1 < aic0, 1).otherwise(0)
    elif lag in (0, 1):
        chosen = F.lit(lag)
    else:
        raise ValueError("lag must be 0, 1 or 'aic'")
    out = sums.withColumn("lag", chosen)
    return out.select(
        *keys,
        "feature",
        "lag",
        F.when(F.col("lag") == 1, F.col("c_n")).otherwise(F.col("a_n")).alias("n"),
        F.when(F.col("lag") == 1, stat1).otherwise(stat0).alias("stat"),
    )


def mean_adf(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean statistic over features."""
    return stats.groupBy(*by).agg(F.avg("stat").alias("mean_stat"))
