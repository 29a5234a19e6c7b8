"""Array expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    The optimizer merges neighbouring projections, so a computed column used
    inside a lambda would be computed again for every array element. Binding it
    as a lambda variable keeps it to one evaluation per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def pin(df: DataFrame, *cols: str) -> DataFrame:
    """Compute columns here, once, below whatever follows.

    The optimizer puts a column's expression wherever the column is used, so one used
    twice is evaluated twice, and a vectorized function merged with nested lambdas is not
    planned at all. A one-element explode is a plan node of its own: nothing is merged across it.
    """
    for c in cols:
        df = df.withColumn(c, F.explode(F.array(c)))
    return df


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def array_mean(a: Column) -> Column:
    return let(a, lambda x: array_sum(x) / F.size(x))


def squared_deviations(a: Column) -> Column:
    """Sum of squared deviations from the mean (two passes, so large levels do not cancel)."""
    return let(
        a, lambda x: let(array_sum(x) / F.size(x), lambda m: array_sum(F.transform(x, lambda v: (v - m) * (v - m))))
    )


def array_var_pop(a: Column) -> Column:
    return let(a, lambda x: squared_deviations(x) / F.size(x))


def array_var_samp(a: Column) -> Column:
    return let(a, lambda x: squared_deviations(x) / F.nullif((F.size(x) - 1).cast("double"), F.lit(0.0)))


def dot(a: Column | str, b: Column | str) -> Column:
    return array_sum(F.zip_with(a, b, lambda p, q: p * q))


def softmax(a: Column) -> Column:
    """Softmax of an array."""
    shifted = let(a, lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
    return let(shifted, lambda e: let(array_sum(e), lambda total: F.transform(e, lambda v: v / total)))


def slices(a: Column, size: int | Column, step: int | Column) -> Column:
    """Consecutive slices of an array, every ``step`` elements, complete ones only."""
    size, step = (F.lit(v) if isinstance(v, int) else v for v in (size, step))
    return let(
        a,
        lambda x: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(x) - size) / step).cast("int")), lambda j: F.slice(x, j * step + 1, size)
        ),
    )
