"""Exact top-k search by inner product with a three-phase uniform threshold.

Scores are sums of local scores: the components are cut into a few lists, and a
vector's local score in a list is the inner product over the list's components.

1. Every list gives, per query, the vectors with its best local scores. Their total
   scores are real ones, so the k-th best of them is a cutoff no result lies below.
2. The cutoffs go back to the queries. A total of at least the cutoff needs a local
   score of at least the cutoff's equal share in one list or more; only such entries
   are collected.
3. The rest of a collected entry's local scores is added, which resolves its total
   exactly; totals below the cutoff go, and the cutoff rises with what was found.

Vectors are packed once into blocks of whole-numbered components in the shared folder.
Every block of queries meets every block of vectors, over several strips, so a block of
queries is no hot key. A worker keeps the k best per query while a strip passes by:
what leaves it is k rows per query and strip, and its memory is one block of each kind.
The work itself is queries times vectors, as an exact search of a stated query set is.

Defined cases: vectors that are null or hold null or non-finite components take no
part; vectors of different lengths do not meet; empty vectors score 0; a query passes over
its own row only, so repeated rows are results of each other; equal scores go by vec_id,
null last; a null vec_id is never a query; an empty table gives no rows; other columns are left out; a vector
of any length must fit a task; scores beyond a long stand at its ends, equal there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import broadcast_if_small, stored

SCALE = 1024
LISTS = 4
BLOCK_NUMBERS = 1 << 19
"""Components in a block of vectors or queries."""
SLAB = 1 << 22
"""Scores a worker holds of a list at a time."""
STRIPS = 32
NO_ID = (1 << 63) - 1
FLOAT32_EXACT, FLOAT64_EXACT = 1 << 24, 1 << 53
LONG = (-(1 << 63), (1 << 63) - 1)

BLOCK = "d int, block int, part long, rows binary, ids binary, cells binary"


def takes_part(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf")))
    return F.coalesce(v.isNotNull() & sound, F.lit(False))


def numbered(vectors: DataFrame) -> DataFrame:
    """row, vec_id, v: whole-numbered vectors that take part. Row numbers are odd where vec_id is null."""
    v = F.col("embedding").cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(x * SCALE).cast("double"))
    # floor() gives a long, which larger doubles, all of them whole, do not fit
    whole = F.when(F.exists(v, lambda x: F.abs(x) >= float(1 << 52)), F.transform(v, lambda x: F.when(F.abs(x) >= float(1 << 52), x * SCALE).otherwise(F.floor(x * SCALE).cast("double")))).otherwise(whole)
    row = F.monotonically_increasing_id() * 2 + F.col("vec_id").isNull().cast("long")
    return stored(vectors.where(takes_part(v)).select(row.alias("row"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")), "numbered")


def packed(rows: DataFrame, number: str) -> DataFrame:
    """Rows of each task and ``block`` packed: row numbers, the column ``number`` and components as bytes, whole numbers as small as they allow.

    ``part`` is the first row number, which no other pack holds.
    """

    def pack(d: int, block: int, part: pa.RecordBatch) -> dict:
        cells = part["v"].flatten().to_numpy(zero_copy_only=False)
        top = np.abs(cells).max(initial=0)
        kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64
        own = part["row"].to_numpy(zero_copy_only=False)
        given = part[number].fill_null(NO_ID).to_numpy(zero_copy_only=False)
        return {"d": d, "block": block, "part": int(own[0]), "rows": own.tobytes(), "ids": given.tobytes(), "cells": bytes([np.dtype(kind).itemsize]) + cells.astype(kind).tobytes()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("d", pa.int32()), ("block", pa.int32()), ("part", pa.int64()), *[(c, pa.binary()) for c in ("rows", "ids", "cells")]])
        for batch in batches:
            sizes = batch["v"].value_lengths().to_numpy(zero_copy_only=False)
            blocks = batch["block"].to_numpy(zero_copy_only=False)
            for d, block in np.unique(np.stack([sizes, blocks], axis=1), axis=0):
                own = batch.filter(pa.array((sizes == d) & (blocks == block)))
                step = max(1, BLOCK_NUMBERS // max(1, int(d)))
                for a in range(0, own.num_rows, step):
                    yield pa.RecordBatch.from_pylist([pack(int(d), int(block), own.slice(a, step))], schema)

    return rows.select("row", number, "v", F.col("block").cast("int").alias("block")).mapInArrow(work, BLOCK)


def unpacked(cells: bytes, d: int, n: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[cells[0]]
    return np.frombuffer(cells, kind, offset=1).astype(np.float64).reshape(n, d)


def exact_kind(q: np.ndarray, x: np.ndarray) -> type:
    """Numbers in which all sums of these products are exact: sums of |q_i x_i| are at most |q||x|."""
    size = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m).max(initial=0.0))
    most = size(q) * size(x) * 1.01
    return np.float32 if most < FLOAT32_EXACT else np.float64 if most < FLOAT64_EXACT else object


def as_kind(m: np.ndarray, kind: type) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) if kind is object else m.astype(kind)


def local_scores(q: np.ndarray, x: np.ndarray, lists: int) -> list[np.ndarray]:
    """Inner products (queries x vectors) over the components of each list."""
    edges = np.linspace(0, q.shape[1], max(1, min(lists, q.shape[1])) + 1).astype(int)
    if q.dtype == object and not q.shape[1]:
        return [np.zeros((len(q), len(x)), object)]
    return [q[:, a:b] @ x[:, a:b].T for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Best:
    """The k best (score, id, row) per query of a block, among entries offered in any order."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.query = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)
        self.row = np.empty(0, np.int64)

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(query):
            return
        score = np.array([min(max(int(s), LONG[0]), LONG[1]) for s in score], np.int64) if score.dtype == object else score.astype(np.int64)
        if len(self.query):
            query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
            ids, rows = np.concatenate([self.id, ids]), np.concatenate([self.row, rows])
        order = np.lexsort((rows, ids, ~score, query))  # ~score falls as score rises, for every long
        first = np.searchsorted(query[order], np.arange(self.n))
        rank = np.arange(len(order)) - first[query[order]]
        order = order[rank < self.k]
        self.query, self.score, self.id, self.row = query[order], score[order], ids[order], rows[order]

    def cutoffs(self, given: np.ndarray) -> np.ndarray:
        """The given cutoffs (objects; None: none), raised to the k-th best score where a query has k."""
        out = given.copy()
        last = np.searchsorted(self.query, np.arange(self.n), side="right") - 1
        full = np.bincount(self.query, minlength=self.n) >= self.k if len(self.query) else np.zeros(self.n, bool)
        for i in np.flatnonzero(full):
            s = int(self.score[last[i]])
            out[i] = s if out[i] is None else max(out[i], s)
        return out


def gathered(local: list[np.ndarray], own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: (query, vector) of the best local scores of every list, each pair once."""
    n, m = local[0].shape
    take = min(k + 1, m)  # the query's own row may be among them
    flat = []
    for s in local:
        best = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < m else np.broadcast_to(np.arange(m), (n, m))
        flat.append((np.arange(n)[:, None] * m + best).reshape(-1))
    pairs = np.unique(np.concatenate(flat))
    i, j = pairs // m, pairs % m
    keep = ~own[i, j]
    return i[keep], j[keep]


def sufficient(local: list[np.ndarray], own: np.ndarray, cutoffs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: (query, vector) with a local score of the cutoff's equal share or more in some list."""
    # whole numbers: s >= cutoff / lists is s >= ceil(cutoff / lists)
    kind = local[0].dtype
    share = np.array([float("-inf") if c is None or c == LONG[0] else -(-c // len(local)) for c in cutoffs], object)
    share = share if kind == object else share.astype(np.float64)
    met = np.zeros(local[0].shape, bool)
    for s in local:
        met |= (s >= share[:, None]).astype(bool)
    return np.nonzero(met & ~own)


def searched(pairs: DataFrame, k: int, lists: int, second: bool) -> DataFrame:
    """Phase 1, or phases 2 and 3 (``second``), over pairs of blocks; query, score, id, row: k rows per query and strip at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, q, q_rows, given = None, None, None, None, None

        def leave() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.query):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_rows[best.query], best.score, best.id, best.row)], ["query", "score", "id", "row"])

        for batch in batches:
            for r in batch.to_pylist():
                if at != (r["q_part"], r["strip"]):
                    yield from leave()
                    at = (r["q_part"], r["strip"])
                    q_rows = np.frombuffer(r["q_rows"], np.int64)
                    q = unpacked(r["q_cells"], r["d"], len(q_rows))
                    best = Best(len(q_rows), k)
                    bound = np.frombuffer(r["q_ids"], np.int64)  # vec_ids in phase 1, cutoffs in phase 2
                    given = np.array([int(b) if second and b != NO_ID else None for b in bound], object)
                rows, ids = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
                x = unpacked(r["cells"], r["d"], len(rows))
                kind = exact_kind(q, x)
                step = max(1, SLAB // max(1, len(q)))
                for a in range(0, len(rows), step):
                    local = local_scores(as_kind(q, kind), as_kind(x[a : a + step], kind), lists)
                    own = q_rows[:, None] == rows[None, a : a + step]
                    i, j = sufficient(local, own, best.cutoffs(given)) if second else gathered(local, own, k)
                    total = sum(s[i, j] for s in local)  # phase 3: what the other lists add
                    best.offer(i, total, ids[a + j], rows[a + j])
        yield from leave()

    return pairs.mapInArrow(work, "query long, score long, id long, row long")


def block_pairs(queries: DataFrame, vectors: DataFrame, blocks: int, strips: int) -> DataFrame:
    """Every pack of queries beside every pack of vectors of the same length, dealt by (block, strip)."""
    left = queries.select(
        "d", "block", F.col("part").alias("q_part"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"),
        F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"),
    )
    right = vectors.drop("block").withColumn("strip", F.pmod(F.xxhash64("part"), F.lit(strips)).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    n = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), strips)
    keys = ["d", "block", "strip"]
    return right.join(left, keys).repartition(n, *keys).sortWithinPartitions(*keys, "q_part")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, lists: int = LISTS, strips: int = STRIPS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, the rows whose vec_id is divisible by ``every``."""
    rows = numbered(vectors)
    asked = rows.where(F.col("vec_id") % every == 0)
    cells = asked.select(F.sum(F.size("v") + 1)).first()[0] or 1
    blocks = max(1, -(-cells // BLOCK_NUMBERS))
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).repartition("block"), "asked")
    packs = stored(packed(rows.withColumn("block", F.lit(0)), "vec_id"), "packs")

    plain = stored(packed(asked, "vec_id"), "queries")
    entries = searched(block_pairs(plain, packs, blocks, strips), k, lists, second=False)
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    ranked = entries.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k)
    cutoffs = stored(ranked.where(F.col("place") == k).select(F.col("query").alias("row"), F.col("score").alias("cutoff")), "cutoffs")
    near = broadcast_if_small(cutoffs, cutoffs.count(), 16)
    bounded = stored(packed(asked.join(near, "row", "left").repartition("block"), "cutoff"), "queries")

    found = searched(block_pairs(bounded, packs, blocks, strips), k, lists, second=True)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    vec_id = F.when(F.col("row") % 2 == 0, F.col("id"))
    return out.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), vec_id.alias("vec_id"), "score")
