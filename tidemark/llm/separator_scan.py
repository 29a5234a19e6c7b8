"""Token counts of documents in flat, unindexed token files.

A flat file is a row of little-endian ids in which an end-of-document id closes
each document. Files are cut into byte ranges; each range is searched for the
separator on its own, whatever file it comes from. A running maximum over the
ranges of a file then carries the last separator across range borders, and a
running count numbers the documents. Only one row per range meets in a file's scan.

Defined cases: a document may be empty; ids after the last separator are one more
document with ``closed`` = false; an empty file has no document; a file whose size
is no multiple of the id width is an error. For ``write_flat``: null text is
empty, null doc_ids and repeated rows are kept as they are, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.encoder import encoder, text_groups
from tidemark.llm.files import listed, read_range, write_whole
from tidemark.llm.shared import stored, trim

RANGE_BYTES = 8 << 20


def write_flat(docs: DataFrame, folder: str, vocabulary: str, end_id: int, dtype: str = "<u2") -> DataFrame:
    """Encode the documents into flat files of ``folder``, one per task, as Spark deals them.

    Returns path, ordinal, doc_id; the files are written when it is computed.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(vocabulary, dtype)
        path = f"{folder}/flat-{TaskContext.get().partitionId():06d}.ids"
        seen: list[pd.DataFrame] = []

        def chunks() -> Iterator[bytes]:
            at = 0
            for batch in batches:
                texts = batch["text"].tolist()
                for a, b in text_groups(texts):
                    yield code.encode_closed(texts[a:b], end_id)[0].tobytes()
                seen.append(pd.DataFrame({"path": path, "ordinal": np.arange(at, at + len(batch)), "doc_id": batch["doc_id"]}))
                at += len(batch)
                trim()

        if write_whole(path, chunks()):
            yield from seen

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInPandas(write, "path string, ordinal long, doc_id string")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def find_separators(spark: SparkSession, folder: str, end_id: int, dtype: str = "<u2", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, block, first (id position of the range), n_ids, seps (positions of the separators in the file)."""
    width = np.dtype(dtype).itemsize
    step = range_bytes // width * width

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length, offset in zip(batch["path"], batch["length"], batch["offset"], strict=True):
                if length % width:
                    raise ValueError(f"{path}: {length} bytes are no whole number of ids")
                ids = np.frombuffer(read_range(path, offset, min(step, length - offset)), dtype)
                seps = np.flatnonzero(ids == end_id) + offset // width
                yield pd.DataFrame({"path": [path], "block": [offset // step], "first": [offset // width], "n_ids": [len(ids)], "seps": [seps]})

    files = listed(spark, folder, "*.ids").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("offset"))
    dealt = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "offset")
    return dealt.mapInPandas(search, "path string, block long, first long, n_ids long, seps array<long>")


def count_tokens(spark: SparkSession, folder: str, end_id: int, dtype: str = "<u2", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, ordinal, start (id position in the file), n_tokens (without the separator), closed: one row per document."""
    found = stored(find_separators(spark, folder, end_id, dtype, range_bytes), "separators")
    w = Window.partitionBy("path").orderBy("block")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select("path", "block", F.size("seps").alias("n"), F.array_max("seps").alias("last"), (F.col("first") + F.col("n_ids")).alias("end"))
    carried = sums.select(
        "path",
        "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        (F.coalesce(F.max("last").over(earlier), F.lit(-1)) + 1).alias("open_since"),
        F.lead("block").over(w).isNull().alias("final"),
        "end",
    )
    met = found.drop("n_ids", "first").join(carried, ["path", "block"])
    inner = met.select(
        "path",
        F.explode(
            F.transform(
                "seps",
                lambda at, i: F.struct(
                    (F.col("before") + i).alias("ordinal"),
                    F.when(i == 0, F.col("open_since")).otherwise(F.get("seps", i - 1) + 1).alias("start"),
                    at.alias("stop"),
                    F.lit(True).alias("closed"),
                ),
            )
        ).alias("d"),
    ).select("path", "d.*")
    tail_start = F.greatest(F.coalesce(F.array_max("seps") + 1, F.lit(0)), F.col("open_since"))
    tail = met.where("final").select(
        "path", (F.col("before") + F.size("seps")).alias("ordinal"), tail_start.alias("start"), F.col("end").alias("stop"), F.lit(False).alias("closed")
    )
    return inner.unionByName(tail.where("stop > start")).select("path", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed")
