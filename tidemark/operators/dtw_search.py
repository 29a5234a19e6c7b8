"""The k nearest windows of the same class by banded warping distance, exactly, with few distances solved.

A query's band envelope (running maximum and minimum) bounds the distance to any window from
below, as do the two end points alone. Windows of a class are dealt to blocks, its queries to tiles, and
every tile meets every block in one group. A group first solves, for each query, the few windows
with the least bounds; the k-th of these distances is a cutoff. Then only windows that
may be among the k nearest are solved. Where bounds tell nothing (noise), that is all of them, so a pair
costs little: windows lie point by point beside each other, and a front of the warping tables of thousands of pairs
is a few passes over numbers. What leaves a group is the k nearest it met of each query: pairs are
never rows, and what is shuffled grows with the windows times tiles and with queries times blocks.

Sizes of blocks and tiles are bounded, so no group grows with its class, and a class with a third of all windows
is no hot key. Windows of other lengths than the query's do not meet it. Windows, labels and ids that are
null take no part. A missing point lets no path through, so the distance is infinite, or without a number where a last
point is missing; equal distances go by id, infinite ones, NaN and null come last, in this order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import warping
from tidemark.operators.ordering import shuffle_width
from tidemark.session import staged

BLOCK = 2048
POINTS = 1 << 20
"""Numbers in a block, a tile, or either side of the pairs that are solved at once."""
PAIRS = 2048
"""Pairs solved at once: more no longer save calls, and fronts leave the cache."""
SLAB = 1 << 17
"""Bounds held at once."""
SLACK = 1e-9
"""Share by which a bound may exceed its distance through rounding."""


def envelope(x: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Extremes (highest, lowest) of windows (time, ...) within the band around each point."""
    band = min(band, len(x) - 1)
    edge = [(band, band)] + [(0, 0)] * (x.ndim - 1)
    near = lambda fill: np.lib.stride_tricks.sliding_window_view(np.pad(x, edge, constant_values=fill), 2 * band + 1, axis=0)
    return near(-np.inf).max(axis=-1), near(np.inf).min(axis=-1)


def end_bound(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """First points meet first points and last ones last: their two distances are part of every path."""
    gap = lambda i: warping.point_length(others[i] - query[i])
    return gap(0) + gap(-1) if len(others) > 1 else gap(0)


def envelope_bound(highest: np.ndarray, lowest: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Every point of the other window meets a point within the band, so lies at least as far as from the envelope."""
    outside = np.maximum(others - highest, lowest - others)
    return warping.point_length(np.maximum(outside, 0.0, out=outside)).sum(axis=0)


def bounds(queries: np.ndarray, others: np.ndarray, band: int) -> np.ndarray:
    """Lower bounds (query, other) of the distances of windows (time, channel, window); NaN where they tell nothing."""
    if not len(others):
        return np.zeros((queries.shape[-1], others.shape[-1]))
    with np.errstate(invalid="ignore", over="ignore"):
        highest, lowest = envelope(queries, band)
        one = lambda i: np.maximum(end_bound(queries[..., i, None], others), envelope_bound(highest[..., i, None], lowest[..., i, None], others))
        return np.stack([one(i) for i in range(queries.shape[-1])])


def _solve(backwards: np.ndarray, others: np.ndarray, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
    """Distances of query i[p] and other window j[p], some pairs at a time."""
    per = max(1, min(PAIRS, POINTS // max(1, others.shape[0] * others.shape[1])))
    out = np.empty(len(i))
    for at in range(0, len(i), per):
        part = slice(at, at + per)
        out[part] = warping.front_distances(np.take(backwards, i[part], axis=-1), np.take(others, j[part], axis=-1), band)
    return out


def search(queries: np.ndarray, others: np.ndarray, own: np.ndarray, k: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, solved), both (query, other): of each query, all that may be among its k nearest are solved, but none of ``own``."""
    bound = bounds(queries, others, band)
    distance, solved = np.full(own.shape, np.inf), np.zeros(own.shape, bool)
    backwards = np.ascontiguousarray(queries[::-1])

    def solve(which: np.ndarray) -> None:
        i, j = np.nonzero(which)
        distance[i, j] = _solve(backwards, others, i, j, band)
        solved[i, j] = True

    limit = np.full(len(own), np.inf)
    if k < own.shape[1]:
        bound[own] = np.inf
        first = np.zeros(own.shape, bool)
        np.put_along_axis(first, np.argpartition(bound, k - 1, axis=1)[:, :k], True, axis=1)
        solve(first & ~own)
        most = np.where(solved, distance, -np.inf).max(axis=1)
        full = (solved.sum(axis=1) >= k) & ~np.isnan(most)
        limit[full] = most[full] * (1 + SLACK) + SLACK
    solve(~solved & ~own & ~(bound > limit[:, None]))
    return distance, solved


def least(distance: np.ndarray, solved: np.ndarray, missing: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, other) of the k least distances of each query, ties to the earlier; NaN after infinite ones, ``missing`` last."""
    worst = np.partition(distance, min(k, distance.shape[1]) - 1, axis=1)[:, min(k, distance.shape[1]) - 1]
    i, j = np.nonzero(solved & ~(distance > worst[:, None]))
    order = np.lexsort((j, distance[i, j], missing[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k]


def _windows(points: pa.Array, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (time, channel, window) of lists that hold channel after channel, and whether a last point is null."""
    flat = points.flatten()
    shape = (len(points), channels, -1) if len(flat) else (len(points), channels, 0)
    x = flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(shape)
    null = flat.is_null().to_numpy(zero_copy_only=False).reshape(shape)
    return np.ascontiguousarray(x.transpose(2, 1, 0)), null[:, :, -1:].any(axis=(1, 2))


def _closest(channels: int, band: int, k: int, id_col: str, every: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a tile and a block id, near_id, distance: the k nearest members of each query, or ``every`` pair that is solved."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = left[id_col].combine_chunks(), right["near_id"].combine_chunks()
        order = pc.sort_indices(names[1])
        near = names[1].take(order)
        codes = pa.chunked_array([names[0], near]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        out = []
        if left.num_rows and right.num_rows:
            queries, query_null = _windows(left["_w"].combine_chunks(), channels)
            others, other_null = _windows(right["_points"].combine_chunks().take(order), channels)
            for at in range(0, len(query_null), step := max(1, SLAB // len(near))):
                part = slice(at, at + step)
                own = codes[: len(query_null)][part, None] == codes[None, len(query_null) :]
                missing = query_null[part, None] | other_null[None]
                distance, solved = search(queries[..., part], others, own, k, band)
                i, j = np.nonzero(solved) if every else least(distance, solved, missing, k)
                out.append((i + at, j, distance[i, j], missing[i, j]))
        i, j, distance, null = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
        return pa.table({id_col: names[0].take(pa.array(i)), "near_id": near.take(pa.array(j)), "distance": pa.array(distance, mask=null)})

    return run


def nearest(
    windows: DataFrame,
    queries: Column,
    k: int = 3,
    band: int = 7,
    cols: Sequence[str] = ("x",),
    id_col: str = "window_id",
    label: str = "label",
    block: int = BLOCK,
    solved: list | None = None,
) -> DataFrame:
    """id, rank, near_id, distance: the k nearest windows of the class for the windows where ``queries`` holds; ties to the smaller id.

    ``solved`` receives the frame of the pairs that are solved, for those who want to count them.
    """
    points = [F.col(c).cast("array<double>") for c in cols]
    keyed = windows.select(id_col, label, F.size(cols[0]).alias("_n"), (points[0] if len(cols) == 1 else F.concat(*points)).alias("_w"), F.coalesce(queries, F.lit(False)).alias("_asked"))
    keyed = staged(keyed.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col("_w").isNotNull()))

    per = F.greatest(F.least(F.lit(block), F.floor(F.lit(POINTS) / F.greatest(F.col("_n") * len(cols), F.lit(1)))), F.lit(1))
    counted = keyed.groupBy(label, "_n").agg(F.count(F.lit(1)).alias("_all"), F.count_if("_asked").alias("_some"))
    sizes = counted.where("_some > 0").select(label, "_n", F.ceil(F.col("_all") / per).alias("_blocks"), F.ceil(F.col("_some") / per).alias("_tiles"))
    placed = keyed.join(sizes, [label, "_n"])
    number = lambda of: F.pmod(F.xxhash64(id_col), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    asked = placed.where("_asked").select(id_col, label, "_n", each("_blocks").alias("_block"), number("_tiles").alias("_tile"), "_w")
    # columns of their own: both sides come from one table
    members = placed.select(
        F.col(id_col).alias("near_id"), F.col(label).alias("_class"), F.col("_n").alias("_length"), number("_blocks").alias("_block"), each("_tiles").alias("_tile"), F.col("_w").alias("_points")
    )

    # a fixed number of partitions: the work behind this is bound by compute, not bytes
    dealt = [f.repartition(shuffle_width(windows), *on).groupBy(*on) for f, on in ((asked, [label, "_n", "_block", "_tile"]), (members, ["_class", "_length", "_block", "_tile"]))]
    fields = T.StructType([asked.schema[id_col], members.schema["near_id"], T.StructField("distance", T.DoubleType())])
    closest = lambda every: dealt[0].cogroup(dealt[1]).applyInArrow(_closest(len(cols), band, k, id_col, every), fields)
    if solved is not None:
        solved.append(closest(True))
    order = Window.partitionBy(id_col).orderBy(F.asc_nulls_last("distance"), "near_id")
    return closest(False).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(id_col, "rank", "near_id", "distance")
