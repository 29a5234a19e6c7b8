"""Connected components of an undirected graph held in a table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent at most, and no parent has one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    roles = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return not roles.where("child > 1 OR (child > 0 AND parent > 0)").head(1)


def contracted(links: DataFrame) -> DataFrame:
    """The links (u, v) of every Arrow batch as stars around their smallest nodes; what is connected stays so."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, code = np.unique(batch[["u", "v"]].to_numpy().T.reshape(-1), return_inverse=True)
            root = forest(len(names), code[: len(batch)], code[len(batch) :])
            some = np.flatnonzero(root != np.arange(len(names)))
            yield pd.DataFrame({"u": names[some], "v": names[root[some]]})

    return links.mapInPandas(work, "u long, v long")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable node of each of n nodes, for links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    met = edges.join(least, "u")
    moved = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of a link; links of a node with itself are left out.

    Links are first contracted batch by batch. Every step then aggregates minima and
    joins them back, so no neighbourhood is gathered; steps are stored, and their
    number grows with the logarithm of the longest path. Ends when only stars are left.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    edges = stored(contracted(edges), "edges")
    while not _is_stars(edges):
        edges = stored(_small_star(_large_star(edges)), "edges")
    edges = edges.distinct()
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
