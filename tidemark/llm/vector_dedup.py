"""Near-duplicate vectors by int8 tile products with error bounds.

Vectors of one label and length are compared with each other. Equal vectors are
first merged into one with a count. The rest is dealt into tiles; every pair of
tiles of a label is one row of work. A vector is scaled to length one and stored as
int8 values times a step; its residual's length bounds what the int8 product can
be off: |x.y - x'.y'| <= |x'||r_y| + |r_x||y'| + |r_x||r_y|. Only pairs that may
reach the threshold are computed again, in double precision from the given
numbers. A tile pair returns link counts and a spanning forest of its links, so
what leaves it is bounded by its vectors, not by their pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with null label or null vec_id, link with nothing; equal
vectors link with each other; rows with one vec_id are one node of the graph;
other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components, forest
from tidemark.llm.shared import carried, stored

THRESHOLD = 0.98
TILE = 1024
CHUNK = 1 << 16
FLOAT32_EXACT = 1 << 24


def usable(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, step, length of the rounded vector and length of its residual, for rows of any length above zero."""
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    unit = scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
    step = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / step[:, None]).astype(np.int8)
    rounded = q * step[:, None]
    rest = unit - rounded
    return q, step, np.sqrt(np.einsum("ij,ij->i", rounded, rounded)), np.sqrt(np.einsum("ij,ij->i", rest, rest))


def cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine of x[i] and y[j] in double precision, in bounded chunks."""
    unit = []
    for m in (x, y):
        scaled = m / np.abs(m).max(axis=1, keepdims=True)
        unit.append(scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None])
    out = np.empty(len(i))
    for a in range(0, len(i), CHUNK):
        out[a : a + CHUNK] = np.einsum("ij,ij->i", unit[0][i[a : a + CHUNK]], unit[1][j[a : a + CHUNK]])
    return out


def possible_pairs(left: tuple, right: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose int8 product plus its error bound reaches the threshold."""
    (q, s, t, e), (p, u, v, f) = left, right
    # sums of int8 products are whole numbers, exact in float32 while below 2**24
    kind = np.float32 if q.shape[1] * 127 * 127 < FLOAT32_EXACT else np.float64
    near = (q.astype(kind) @ p.astype(kind).T).astype(np.float64) * s[:, None] * u[None, :]
    bound = t[:, None] * f[None, :] + e[:, None] * v[None, :] + e[:, None] * f[None, :]
    return np.nonzero(near + bound >= threshold - 1e-12)


def linked(tiles: DataFrame, threshold: float) -> DataFrame:
    """id, links, root: partial link counts and forest of every tile pair (ids2 is null within a tile)."""

    def load(vectors) -> np.ndarray:
        return np.stack([np.asarray(v, np.float64) for v in vectors])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, times, x = np.asarray(row.ids), np.asarray(row.times), load(row.vectors)
                own = row.ids2 is None
                ids2, times2, y = (ids, times, x) if own else (np.asarray(row.ids2), np.asarray(row.times2), load(row.vectors2))
                left = quantise(x)
                i, j = possible_pairs(left, left if own else quantise(y), threshold)
                if own:
                    i, j = i[i < j], j[i < j]
                real = cosines(x, y, i, j) >= threshold
                i, j = i[real], j[real]
                if not len(i):
                    continue
                base = 0 if own else len(ids)
                links = np.zeros(base + len(ids2), np.int64)
                np.add.at(links, i, times2[j])
                np.add.at(links, base + j, times[i])
                names = ids if own else np.concatenate([ids, ids2])
                root = forest(len(names), i, base + j)
                some = np.flatnonzero(links)
                yield pd.DataFrame({"id": names[some], "links": links[some], "root": names[root[some]]})

    return tiles.mapInPandas(work, "id long, links long, root long")


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """All columns of ``vectors`` plus n_links, component_id, kept."""
    spark = vectors.sparkSession
    good = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    node = F.col("vec_id").cast("long")
    classes = stored(
        vectors.where(good)
        .groupBy("label", F.col("embedding").cast("array<double>").alias("v"))
        .agg(F.min(node).alias("id"), F.count(F.lit(1)).alias("times")),
        "vectors",
    )
    sizes = classes.groupBy("label", F.size("v").alias("d")).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    # the tile comes from the vector, so equal ids of different vectors do not matter
    dealt = classes.withColumn("d", F.size("v")).join(sizes, ["label", "d"]).withColumn("tile", F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int"))
    packed = stored(
        dealt.groupBy("label", "d", "tile", "tiles").agg(F.collect_list(F.struct("id", "times", "v")).alias("m")).select(
            "label", "d", "tile", "tiles", F.col("m")["id"].alias("ids"), F.col("m")["times"].alias("times"), F.col("m")["v"].alias("vectors")
        ),
        "tiles",
    )
    wide = packed.withColumn("other", F.explode(F.sequence("tile", F.col("tiles") - 1))).drop("tiles")
    right = packed.select("label", "d", F.col("tile").alias("other"), F.col("ids").alias("ids2"), F.col("times").alias("times2"), F.col("vectors").alias("vectors2"))
    cross = wide.where("other > tile").join(right, ["label", "d", "other"])
    same = wide.where("other = tile").select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in ("ids2", "times2", "vectors2")])
    columns = ["ids", "times", "vectors", "ids2", "times2", "vectors2"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = same.select("label", "tile", "other", *columns).unionByName(cross.select("label", "tile", "other", *columns)).repartition(n, "label", "tile", "other")
    found = stored(linked(work.select(*columns), threshold), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("others"))
    members = components(found, "id", "root")
    known = (
        classes.join(counts, "id", "left")
        .join(members, F.col("id") == F.col("node"), "left")
        .select(
            F.col("label").alias("_label"),
            F.col("v").alias("_v"),
            (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("_links"),
            F.coalesce("component", "id").alias("_component"),
        )
    )
    inner, finish = carried(vectors, "vec_id", "embedding", "label")
    keyed = inner.withColumn("_e", F.when(good, F.col("embedding").cast("array<double>")))
    joined = keyed.join(known, (keyed["label"] == known["_label"]) & (keyed["_e"] == known["_v"]), "left")
    component = F.coalesce("_component", node)
    out = joined.withColumns(
        {
            "n_links": F.coalesce("_links", F.lit(0)).cast("long"),
            "component_id": component,
            "kept": F.coalesce(component == node, F.lit(True)),
        }
    )
    return finish(out, "n_links", "component_id", "kept")
