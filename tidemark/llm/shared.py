"""Helpers of this subpackage: the cluster's shared folder, stored tables, document keys, words."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
"""What stands between the words of lower-cased texts."""

BROADCAST_BYTES = 32 << 20
"""Largest table that is broadcast; larger ones are joined by a shuffle."""


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    A local session that names none gets a temporary folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go with the job that wrote them, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table to the shared folder and go on from it: cuts lineage, survives lost executors; its shuffles' files end with the write."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with shuffles_end(spark):
        # planned anew, so that the setting holds for it
        df.select("*").write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Give back the space of stored tables that nothing reads any more, by writing an empty table over each."""
    for table in tables:
        spark, files = table.sparkSession, table.inputFiles()
        if files:
            spark.createDataFrame([], table.schema).coalesce(1).write.mode("overwrite").parquet(unquote(files[0]).rsplit("/", 1)[0])


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast a table whose counted rows, of at most ``row_bytes`` each, fit BROADCAST_BYTES; else leave it to a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


HOT_SHARE, LEAST_HOT = 4, 1000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, spread: str, total: int | None = None) -> DataFrame:
    """Left join of stored rows with one row per class (``key``, ``n`` rows of it, values), where one class may hold a third of all rows.

    Fewer than HOT_SHARE * partitions classes can each hold more than 1 / (HOT_SHARE * partitions)
    of all rows (``total``, else counted): these few are broadcast, and their rows are dealt by ``spread``. The others meet by a shuffle on the key.
    """
    values = [c for c in classes.columns if c not in (key, "n")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(LEAST_HOT, (rows.count() if total is None else total) // (HOT_SHARE * n))
    hot = classes.where(F.col("n") > least).select(key, F.struct(*values).alias("_hot"))
    cold = classes.where(F.col("n") <= least).select(F.xxhash64(key).alias("_k"), F.col(key).alias("_key"), F.struct(*values).alias("_cold"))
    met = rows.join(F.broadcast(hot), key, "left")
    place = F.when(F.col("_hot").isNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.lit("hot"), F.col(spread)))
    met = met.withColumn("_place", place)
    joined = met.join(cold, (met["_place"] == cold["_k"]) & (met[key] == cold["_key"]), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col("_hot")[v], F.col("_cold")[v]).alias(v) for v in values])


def text_key(text: Column | str) -> Column:
    """Hash of a text (null: empty) that tells rows with one doc_id apart; rows equal in both are one document."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def ascii_words(text: Column | str) -> Column:
    """Words of a text: A-Z lower-cased, then runs of ASCII letters and digits and of everything beyond ASCII."""
    text = F.col(text) if isinstance(text, str) else text
    # cut at what is between words: a third of the time that gathering matches takes
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def upto(n: Column) -> Column:
    """0, 1, ..., n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def same_row(a: DataFrame, b: DataFrame, *cols: str) -> Column:
    """Null-safe equality on columns of two frames."""
    out = None
    for c in cols:
        part = a[c].eqNullSafe(b[c])
        out = part if out is None else out & part
    return out


def worker_state(owner: str) -> dict:
    """A dict that lives as long as the Python worker, or until another operator (``owner``) begins in it.

    The functions of this package travel by value, so their own globals end with the task.
    """
    held = vars(sys.modules.setdefault("_tidemark_worker_state", types.ModuleType("_tidemark_worker_state")))
    if held.get("owner") != owner:
        held["owner"], held["kept"] = owner, {}
        trim()
    return held["kept"]


def trim() -> None:
    """Give freed memory of this Python worker back to the machine; workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def carried(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The needed columns, all others under names of no meaning, and what turns a result back.

    Whatever the other columns are called, an operator's own columns cannot clash
    with them. ``finish(out, *new)`` gives the columns of ``df`` in order, then the
    new ones; a column of ``df`` called like a new one is replaced by it.
    """
    hidden = {c: f"_carry{i}" for i, c in enumerate(df.columns) if c not in needed}
    inner = df.select(*needed, *[F.col(f"`{c}`").alias(h) for c, h in hidden.items()])

    def finish(out: DataFrame, *new: str) -> DataFrame:
        old = [F.col(hidden[c]).alias(c) if c in hidden else F.col(c) for c in df.columns if c not in new]
        return out.select(*old, *new)

    return inner, finish
