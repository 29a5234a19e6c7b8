"""Filter interaction audit: what five document filters remove alone, together and in every order.

A sparse document-term matrix decides the two word filters. Every task numbers the words
of a few megabytes of text and writes them as a shard in compressed sparse rows: row
pointers, numbers and counts, with the shard's words. A dictionary over all shards gives
every distinct word a code and proves that no two share one; the shards' numbers stand for
these codes. A document's row sum is its words, its nonzero entries are its distinct words.
Flags of the other filters travel beside the rows. Documents then become one failure mask
each, masks are counted by part, and all 120 orders are summed over at most 32 counts a part.

Filters: A under 50 words; B fewer than 65 distinct words per 100; C more than 5 capitals
per 100 code points; D holds a sign of ``#$%&*|``; E a smaller doc_id has the same text.

Texts are compared by 128-bit digests. Digests with more than a share of all rows are known to be
few, so their first documents are broadcast; the others are joined by a shuffle of slim rows.

Defined cases: null text is empty and has no word (it fails A; 0 < 0 does not fail B); null source is the part of the
empty string; a null doc_id fails E never and has no labels; repeated rows of one doc_id are documents each, not
copies of each other; several label rows of one doc_id count as one that holds each 1 among them; texts of any
length are whole rows of a shard of their own, a task holds about eight times the text; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import join_classes, stored, trim

FILTERS = "ABCDE"
ORDERS = list(permutations(FILTERS))
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, "#$%&*|"
SHARD_BYTES = 4 << 20
SHARD = (
    "doc_ids array<long>, parts array<string>, digests array<binary>, flags array<int>, "
    "pointers binary, numbers binary, counts binary, words array<string>"
)


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def code(word: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), word)


def byte_counts(texts: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """How many bytes of each text are among the wanted (256 booleans)."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or ends[-1] == ends[0]:
        return np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    places = np.flatnonzero(wanted[data]) + ends[0]
    return np.searchsorted(places, ends[1:]) - np.searchsorted(places, ends[:-1])


def shard(doc_ids: pa.Array, parts: pa.Array, texts: pa.Array) -> dict:
    """One shard: rows in compressed sparse form, with the flags that need no words."""
    texts = texts.fill_null("").cast(pa.large_string())
    capital, sign = np.zeros(256, bool), np.zeros(256, bool)
    capital[ord("A") : ord("Z") + 1] = True
    sign[[ord(c) for c in SIGNS]] = True
    too_loud = 100 * byte_counts(texts, capital) > MOST_CAPITALS * pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    flags = bit("C") * too_loud + bit("D") * (byte_counts(texts, sign) > 0)
    digests = [hashlib.blake2b(b, digest_size=16).digest() for b in texts.cast(pa.large_binary()).to_pylist()]

    split = pc.ascii_split_whitespace(texts)
    row = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    words = split.flatten()
    real = pc.not_equal(pc.binary_length(words), 0)
    row, words = row[real.to_numpy(zero_copy_only=False)], words.filter(real)
    coded = words.dictionary_encode()
    width = max(1, len(coded.dictionary))
    keys, counts = np.unique(row.astype(np.int64) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    pointers = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.int64) * width)
    most = counts.max(initial=0)
    small = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64
    return {
        "doc_ids": doc_ids, "parts": parts, "digests": pa.array(digests, pa.binary()), "flags": pa.array(flags.astype(np.int32)),
        "pointers": pointers.astype(np.int64).tobytes(), "numbers": (keys % width).astype(np.int32).tobytes(),
        "counts": bytes([np.dtype(small).itemsize]) + counts.astype(small).tobytes(), "words": coded.dictionary.cast(pa.string()),
    }


def term_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The document-term matrix of ``docs`` (doc_id, part, text) in shards of about ``shard_bytes`` of text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())]
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            a = 0
            while a < batch.num_rows:
                before = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, before + shard_bytes, side="right")))
                made = shard(*[batch[c].slice(a, b - a) for c in ("doc_id", "part", "text")])
                columns = [
                    pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if pa.types.is_list(kind) else pa.array([v], kind)
                    for v, kind in zip(made.values(), kinds, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(columns, names=list(made))
                a = b
            trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "part", "text").mapInArrow(work, SHARD)


def term_dictionary(shards: DataFrame) -> tuple[DataFrame, int]:
    """(term, word) of every distinct word, and the seed whose codes tell all words apart.

    Codes have 64 bits: one round is enough below about 10**9 distinct words, a few up to 10**10.
    """
    seed = 0
    words = shards.select(F.explode("words").alias("word"))
    while True:
        terms = stored(words.select(code(F.col("word"), seed).alias("term"), "word").distinct(), "terms")
        if not terms.groupBy("term").count().where("count > 1").head(1):
            return terms, seed
        seed += 1


def encoded(shards: DataFrame, seed: int) -> DataFrame:
    """The shards with the codes of their words in place of these."""
    return shards.withColumn("terms", F.transform("words", lambda w: code(w, seed))).drop("words")


def row_totals(shards: DataFrame) -> DataFrame:
    """doc_id, part, digest, flags, n_words (row sum) and n_distinct (nonzero entries) of every row of the encoded matrix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1)
                pointers = np.frombuffer(r["pointers"][0].as_buffer(), np.int64)
                raw = r["counts"][0].as_buffer().to_pybytes()
                counts = np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 8: np.int64}[raw[0]], offset=1)
                sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                terms = r["terms"].flatten().to_numpy(zero_copy_only=False)
                if len(np.unique(terms)) < len(terms):
                    raise ValueError("two words of a shard share a code")
                columns = [r[c].flatten() for c in ("doc_ids", "parts", "digests", "flags")]
                columns += [pa.array(sums[pointers[1:]] - sums[pointers[:-1]]), pa.array(np.diff(pointers))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "digest", "flags", "n_words", "n_distinct"])

    slim = shards.select("doc_ids", "parts", "digests", "flags", "pointers", "counts", "terms")
    return slim.mapInArrow(work, "doc_id long, part string, digest binary, flags int, n_words long, n_distinct long")


def with_copies(rows: DataFrame) -> DataFrame:
    """Adds ``copy``: a smaller doc_id has the same digest."""
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = join_classes(rows, stored(groups, "copies"), "digest", "doc_id")
    return met.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first")


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: fails the i-th filter), n, good, toxic: documents counted by part and mask."""
    shards = stored(term_shards(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")), "shards")
    _, seed = term_dictionary(shards)
    rows = with_copies(stored(row_totals(encoded(shards, seed)), "rows"))
    mask = (
        F.col("flags")
        + F.when(F.col("n_words") < LEAST_WORDS, bit("A")).otherwise(0)
        + F.when(100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"), bit("B")).otherwise(0)
        + F.when(F.col("copy"), bit("E")).otherwise(0)
    )
    marks = (
        labels.where("quality = 1 OR toxic = 1")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    slim = rows.select("doc_id", "part", mask.cast("int").alias("mask"))
    met = slim.join(marks, "doc_id", "left")
    return met.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counted = failure_masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    steps = ", ".join(
        f"struct('{''.join(order)}' AS filter_order, {i + 1} AS step, {bit(name)} AS own, {sum(bit(x) for x in order[:i])} AS before)"
        for order in ORDERS
        for i, name in enumerate(order)
    )
    spread = counted.withColumn("s", F.explode(F.expr(f"array({steps})"))).select("part", "m", "s.*")
    has = lambda x, y: F.lit(0) != x["mask"].bitwiseAND(F.col(y))

    def total(value, where) -> Column:
        return F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + F.when(where(x), value(x)).otherwise(0))

    n = lambda x: x["n"]
    removed = lambda x: has(x, "own") & ~has(x, "before")

    def first_orders(x) -> Column:
        """Documents times the orders in which the own filter comes first among those they fail."""
        failing = F.bit_count(x["mask"]).cast("long")
        return x["n"] * F.floor(F.lit(len(ORDERS)) / F.greatest(failing, F.lit(1)))

    return spread.select(
        "part", "filter_order", "step",
        total(n, lambda x: ~has(x, "own") & ~has(x, "before")).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda x: has(x, "own") & has(x, "before")).alias("redundant"),
        total(n, lambda x: x["mask"] == F.col("own")).alias("unique_fails"),
        total(lambda x: x["good"], removed).alias("good_lost"),
        total(lambda x: x["toxic"], removed).alias("toxic_lost"),
        total(first_orders, lambda x: has(x, "own")).alias("shapley"),
    )
