"""Discrete Fourier transforms of array columns as array expressions.

The cosines and sines of a length are tabulated once per array; a bin is the sum of
the values times every ``bin``-th entry, taken round the table. The work is length times
bins, which suits windows; ``operators.spectral`` sums long ones as rows instead. A null
or empty array has a null transform.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arrays import array_sum, let

DOUBLES = T.ArrayType(T.DoubleType())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_tables(n: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Evaluate ``body`` with the cosines and sines of j / n of a turn, for j = 0 .. n - 1."""
    turns = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.lit(2 * math.pi) * j / n)
    return let(F.transform(turns, F.cos), lambda c: let(F.transform(turns, F.sin), lambda s: body(c, s)))


def at(table: Column, i: Column) -> Column:
    """Entry i of a table that repeats."""
    return F.element_at(table, (i % F.size(table) + 1).cast("int"))


def bins_of(n: Column) -> Column:
    return F.sequence(F.lit(0), F.floor(n / 2).cast("int"))


def coefficients(x: Column, bins: Column) -> Column:
    """array<struct<bin, re, im>> of the chosen bins."""

    def one(b: Column, cos: Column, sin: Column) -> Column:
        part = lambda table: array_sum(F.transform(x, lambda v, j: v * at(table, b * j)))
        return F.struct(b.alias("bin"), part(cos).alias("re"), (-part(sin)).alias("im"))

    return with_tables(F.size(x), lambda cos, sin: F.transform(bins, lambda b: one(b, cos, sin)))


def synthesis(parts: Column, n: Column) -> Column:
    """The real array of length n whose transform has these bins (and their conjugates) and no others."""

    def value(j: Column, cos: Column, sin: Column) -> Column:
        once = lambda p: (p["bin"] == 0) | (2 * p["bin"] == n)
        share = lambda p: F.when(once(p), 1.0).otherwise(2.0) / n
        return array_sum(F.transform(parts, lambda p: share(p) * (p["re"] * at(cos, p["bin"] * j) - p["im"] * at(sin, p["bin"] * j))))

    return with_tables(n, lambda cos, sin: F.transform(F.sequence(F.lit(0), n - 1), lambda j: value(j, cos, sin)))


def _filled(x: Column, value: Column) -> Column:
    return F.when(F.size(x) > 0, value)


def rfft(col: Column | str) -> Column:
    """Non-negative frequency bins as ``struct<re, im>``."""

    def split(parts: Column) -> Column:
        return F.struct(F.transform(parts, lambda p: p["re"]).alias("re"), F.transform(parts, lambda p: p["im"]).alias("im"))

    return let(_col(col), lambda x: _filled(x, let(coefficients(x, bins_of(F.size(x))), split)))


def amplitude(spectrum: Column) -> Column:
    return F.zip_with(spectrum["re"], spectrum["im"], lambda a, b: F.sqrt(a * a + b * b))


def phase(spectrum: Column) -> Column:
    return F.zip_with(spectrum["re"], spectrum["im"], lambda a, b: F.atan2(b, a))


def keep_bins(col: Column | str, bins: Column) -> Column:
    """The part of each array that lies in the given frequency bins; only these are computed."""

    def part(x: Column) -> Column:
        own = F.filter(F.array_distinct(bins), lambda b: (b >= 0) & (b <= F.floor(F.size(x) / 2)))
        return let(coefficients(x, own), lambda parts: synthesis(parts, F.size(x)))

    return let(_col(col), lambda x: _filled(x, part(x)))


def strongest_part(col: Column | str, k: int) -> Column:
    """The part of each array in its k strongest non-constant bins, the weakest of them left out."""

    def part(x: Column) -> Column:
        strength = lambda p: F.when(p["bin"] == 0, 0.0).otherwise(F.sqrt(p["re"] * p["re"] + p["im"] * p["im"]))
        rated = lambda parts: F.transform(parts, lambda p: F.struct(strength(p).alias("strength"), p.alias("p")))

        def strong(rs: Column) -> Column:
            order = F.sort_array(F.transform(rs, lambda r: r["strength"]), asc=False)
            return let(F.get(order, F.lit(k - 1)), lambda limit: F.transform(F.filter(rs, lambda r: r["strength"] > limit), lambda r: r["p"]))

        all_bins = coefficients(x, bins_of(F.size(x)))
        return let(let(let(all_bins, rated), strong), lambda parts: synthesis(parts, F.size(x)))

    return let(_col(col), lambda x: _filled(x, part(x)))


def circular_correlation(query: Column | str, key: Column | str) -> Column:
    """c[lag] = sum_i query[(i + lag) mod L] * key[i]. Of one column, a lag and its mirror are the same sum."""
    same = isinstance(query, str) and query == key

    def correlate(q: Column, k: Column) -> Column:
        one = lambda lag: array_sum(F.transform(k, lambda v, i: v * at(q, i + lag)))
        n = F.size(k)
        if not same:
            return F.transform(F.sequence(F.lit(0), n - 1), one)
        half = F.transform(bins_of(n), one)
        # lags 0 .. n/2, then the mirrors of (n-1)/2 .. 1
        mirrored = lambda h: F.concat(h, F.reverse(F.slice(h, F.lit(2), F.floor((n - 1) / 2).cast("int"))))
        return let(half, mirrored)

    return let(_col(query), lambda q: let(_col(key), lambda k: _filled(k, correlate(q, k))))
