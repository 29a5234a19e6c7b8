"""Files of tasks in the shared folder: whole writes, range reads, listings by Spark."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def located(uri: str):
    """(file system, path) of a URI or an absolute path."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, chunks: Iterable[bytes]) -> int:
    """Write a file under another name and move it in place, so a retried or doubled task leaves one whole file. Returns its bytes."""
    store, path = located(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    size = 0
    with store.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(part, path)
    return size


def read_range(uri: str, offset: int, size: int) -> bytes:
    store, path = located(uri)
    with store.open_input_file(path) as f:
        return f.read_at(size, offset)


def listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, length of the files of a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length"))
