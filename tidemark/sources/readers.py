"""Readers: wide CSV series, labelled pairs of files, label intervals, array files."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.cleaning import attach_labels, binary_label, label_column
from tidemark.operators.ordering import CHUNK, running_totals, shuffle_width
from tidemark.sources.ranges import read_range

FILE_STEM = r"([^/]+?)(\.[A-Za-z0-9]+)?$"


def read_trimmed_csv(
    spark: SparkSession, paths: str | Sequence[str], sep: str = ",", schema: str | T.StructType | None = None
) -> DataFrame:
    """CSV with header; blanks around column names are removed. Give a schema to avoid an inference pass."""
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(list(paths) if not isinstance(paths, str) else paths)
    return df.toDF(*[c.strip() for c in df.columns])


def series_name(path: Column, given: str | Sequence[str]) -> Column:
    """A file's path below the shared folder of the given paths, without extension."""
    parts = [p.rstrip("/").split("://")[-1].split("/") for p in ([given] if isinstance(given, str) else given)]
    shared = parts[0]
    for other in parts[1:]:
        shared = shared[: next((i for i, (a, b) in enumerate(zip(shared, other)) if a != b), min(len(shared), len(other)))]
    plain = [p for p in shared if p]
    stop = next((i for i, p in enumerate(plain) if any(c in p for c in "*?[{")), len(plain))
    root = "/".join(plain[:stop])
    below = F.regexp_extract(path, "^.*?" + re.escape(root) + "/(.+?)(\\.[A-Za-z0-9]+)?$", 1)
    return F.when(below == "", F.regexp_extract(path, FILE_STEM, 1)).otherwise(below)


def read_wide_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    ts_col: str | None = None,
    sep: str = ",",
    schema: str | T.StructType | None = None,
    ts_format: str | None = None,
    drop: Sequence[str] = (),
    key: Column | None = None,
) -> DataFrame:
    """Wide series: a timestamp column (the first unless named), numeric features after it.

    Every file is one series; its path below the folder that the given paths share,
    without extension, becomes ``series_id``. Where several files make up a series,
    give ``key``, an expression over the columns and ``_metadata.file_path``.
    """
    df = read_trimmed_csv(spark, paths, sep, schema).drop(*drop)
    ts = ts_col or df.columns[0]
    stamp = F.to_timestamp(F.col(ts).cast("string"), ts_format) if ts_format else F.to_timestamp(F.col(ts))
    features = [c for c in df.columns if c != ts]
    return df.select(
        (series_name(F.col("_metadata.file_path"), paths) if key is None else key).alias("series_id"),
        stamp.alias("ts"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in features],
    )


HEADER_READ = 1 << 16


def headers(spark: SparkSession, paths: str | Sequence[str], sep: str = ",") -> DataFrame:
    """path, names: the column names of every CSV file, from its first bytes only."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first = [read_range(p, 0, HEADER_READ).decode("utf-8-sig", "replace").splitlines() for p in batch["path"]]
            names = [[c.strip() for c in next(csv.reader(lines[:1], delimiter=sep), [])] for lines in first]
            yield pd.DataFrame({"path": batch["path"], "names": names})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(paths if isinstance(paths, str) else list(paths))
    return files.where("length > 0").select("path").mapInPandas(read, "path string, names array<string>")


def read_stacked_csvs(spark: SparkSession, paths: str | Sequence[str], sep: str = ",", types: dict[str, str] | None = None, default: str = "double") -> DataFrame:
    """Files with differing columns stacked by name; a column a file lacks is null there.

    One pass reads the headers; files with equal headers are then one typed read, so the number of jobs
    and of branches of the plan depends on the number of different headers, not of files. Columns have the ``types`` given, others ``default``.
    """
    groups = headers(spark, paths, sep).groupBy("names").agg(F.array_sort(F.collect_list("path")).alias("paths")).orderBy("names").collect()
    if not groups:
        raise ValueError("no file with a header")
    parts = []
    for names, own in groups:
        schema = T.StructType([T.StructField(c, T._parse_datatype_string((types or {}).get(c, default))) for c in names])
        parts.append(spark.read.option("header", True).option("sep", sep).option("enforceSchema", True).schema(schema).csv(list(own)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_labelled(
    spark: SparkSession,
    data: str,
    labels: str,
    on: str | None = None,
    preferred: str = "attack",
    normal: str | None = None,
    key: Column | None = None,
    schema: str | None = None,
    label_schema: str | None = None,
) -> DataFrame:
    """Features and labels from two sets of files, joined on the timestamp, rows with nulls dropped after the join.

    With several series ``key`` names the series of a file, an expression over ``_metadata.file_path``; the join is then on
    series and timestamp. Schemas avoid a pass over the files that infers them.
    """
    left, right = read_trimmed_csv(spark, data, schema=schema), read_trimmed_csv(spark, labels, schema=label_schema)
    time = on or left.columns[0]
    own = right.columns
    right = right.withColumnRenamed(own[0], time) if time not in own else right
    keys = [time]
    if key is not None:
        left, right = left.select(key.alias("series_id"), *left.columns), right.select(key.alias("series_id"), *right.columns)
        keys = ["series_id", time]
    named = binary_label(right, label_column(right, preferred), normal, "label").select(*keys, "label")
    return attach_labels(left, named, keys).dropna()


def read_train_test(
    spark: SparkSession, train: str, train_labels: str, test: str, test_labels: str, on: str | None = None, **options
) -> DataFrame:
    """Four files, or sets of files, as one frame with a ``part`` column (train or test)."""
    parts = [
        read_labelled(spark, d, lab, on, **options).withColumn("part", F.lit(name))
        for name, d, lab in (("train", train, train_labels), ("test", test, test_labels))
    ]
    return parts[0].unionByName(parts[1])


# -- label intervals -----------------------------------------------------------------------------------


def parse_intervals(df: DataFrame, text: str, key: str = "series_id") -> DataFrame:
    """Rows (key, start, end) from a JSON list such as ``[[5, 9], 20]``; a number is a one-point interval.

    The text is parsed as JSON, never evaluated.
    """
    items = df.select(key, F.explode(F.from_json(text, "array<string>")).alias("_item"))
    bounds = F.when(
        F.col("_item").startswith("["), F.from_json("_item", "array<bigint>")
    ).otherwise(F.array(F.col("_item").cast("bigint")))
    return items.select(key, bounds.alias("_b")).select(
        key, F.element_at("_b", 1).alias("start"), F.element_at("_b", -1).alias("end")
    )


def label_from_intervals(
    df: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("series_id",), idx: str = "idx", block: int = 4096, name: str = "label"
) -> DataFrame:
    """0/1 per point: inside any interval (both ends included) or not.

    A sweep: an interval opens at its start and closes behind its end, and a running total
    in index order counts the open ones. Work is linear in points plus intervals however
    these overlap; chunks of the index carry the total, so no series is one task.
    """
    keys = list(keys)
    edge = lambda at, sign: F.struct(at.cast("long").alias("at"), F.lit(sign).alias("sign"))
    sound = intervals.where("start <= end")
    edges = sound.select(*keys, F.explode(F.array(edge(F.col("start"), 1), edge(F.col("end") + 1, -1))).alias("_e"))
    events = edges.groupBy(*keys, F.col("_e.at").alias("_at")).agg(F.sum("_e.sign").alias("_change")).withColumn("_point", F.lit(0))
    points = df.withColumns({"_at": F.col(idx).cast("long"), "_change": F.lit(0).cast("long"), "_point": F.lit(1)})
    both = points.unionByName(events, allowMissingColumns=True).withColumn(CHUNK, F.floor(F.col("_at") / block).cast("long"))
    # at one place edges come before the point
    swept = running_totals(both, keys, ["_at", "_point"], {"_open": F.col("_change")}, levels=1)
    return swept.where("_point = 1").select(*df.columns, F.when(F.col("_open") > 0, 1).otherwise(0).alias(name))


# -- array files ---------------------------------------------------------------------------------------


ARRAY_ROWS = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("x", T.ArrayType(T.DoubleType())),
    ]
)
ROWS_PER_BATCH = 50_000
HEADER_BYTES = 1 << 16
LAYOUT = "path string, series_id string, offset long, n long, width long, dtype string, columns_first boolean"


def _layout(raw: bytes) -> tuple[int, tuple[int, ...], bool, np.dtype]:
    """Offset of the data, shape, whether columns come first, and type of an array file, from its first bytes."""
    head = io.BytesIO(raw)
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(head)
    return head.tell(), shape, fortran, dtype


def read_arrays(spark: SparkSession, path: str, pattern: str = "*.np[yz]", rows: int = ROWS_PER_BATCH) -> DataFrame:
    """Array files, one series per file: rows of ``series_id, idx, x`` (x has one element per feature).

    Of an array file only the header is read first; ranges of its rows are then
    separate rows of work, so a file of any size is spread over all tasks. Zipped
    files cannot be read in ranges: each is one task, up to Spark's 2 GB per value.
    """

    def layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, sid in zip(batch["path"], batch["series_id"], strict=True):
                offset, shape, fortran, dtype = _layout(read_range(path, 0, HEADER_BYTES))
                width = int(np.prod(shape[1:], dtype=np.int64))
                out = [path, sid, offset, shape[0], width, dtype.str, bool(fortran and len(shape) > 1)]
                yield pd.DataFrame([out], columns=["path", "series_id", "offset", "n", "width", "dtype", "columns_first"])

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                dtype, count = np.dtype(r.dtype), min(rows, r.n - r.at)
                get = lambda first, size, p=r.path, o=r.offset, t=dtype: np.frombuffer(read_range(p, o + first * t.itemsize, size * t.itemsize), t)
                if r.columns_first:
                    part = np.stack([get(c * r.n + r.at, count) for c in range(r.width)], axis=1)
                else:
                    part = get(r.at * r.width, count * r.width).reshape(count, r.width)
                yield pd.DataFrame({"series_id": r.series_id, "idx": np.arange(r.at, r.at + count), "x": list(part.astype(float))})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sid, content in zip(batch["series_id"], batch["content"], strict=True):
                loaded = np.load(io.BytesIO(content), allow_pickle=False)
                array = loaded[loaded.files[0]]
                array = array.reshape(len(array), -1)
                for at in range(0, len(array), rows):
                    part = array[at : at + rows].astype(float)
                    yield pd.DataFrame({"series_id": sid, "idx": np.arange(at, at + len(part), dtype=np.int64), "x": list(part)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    named = files.withColumn("series_id", series_name(F.col("path"), path))
    plain = named.where(F.col("path").endswith(".npy")).select("path", "series_id").mapInPandas(layouts, LAYOUT).where("n > 0")
    pieces = plain.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(rows).cast("long"))))
    dealt = pieces.repartition(shuffle_width(files), "path", "at")
    zipped = named.where(~F.col("path").endswith(".npy")).select("series_id", "content")
    return dealt.mapInPandas(ranges, ARRAY_ROWS).unionByName(zipped.mapInPandas(whole, ARRAY_ROWS))


def unpack(df: DataFrame, names: Sequence[str], col: str = "x") -> DataFrame:
    """Feature columns from an array column."""
    return df.select(*[c for c in df.columns if c != col], *[F.col(col)[i].alias(n) for i, n in enumerate(names)])


def pack(df: DataFrame, features: Sequence[str], name: str = "x") -> DataFrame:
    """Array column from feature columns."""
    packed: Column = F.array(*[F.col(c).cast("double") for c in features])
    return df.select(*[c for c in df.columns if c not in features], packed.alias(name))
