"""Token files in patched frame-of-reference blocks.

A file holds whole documents, in order of doc_id. Its ids are cut into blocks of
512. A block stores its minimum, then every id less the minimum in a width that
holds a chosen percentile of them; larger ones go to an exception list of
positions and values. After the blocks stand the documents (id, length), the start
of every block, and a footer, so any range of ids is read without the rest.

    magic | blocks | documents | block starts | footer

Files are numbered by (part, seq): parts are ranges of doc_id, one per writing
task; a file is closed at the first document end at or after FILE_TOKENS ids. A
task holds one file's ids. Files are written whole and moved in place.

Defined cases: null text is empty (the end id alone); null doc_ids come first;
rows with one doc_id are ordered by their text's hash, equal rows are written each; a
table without rows gives no file; a special token's string in a text is that token's id, as the
library has it; a text of any length is encoded whole, a task holds some 20 bytes per character of it. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.encoder import encoder, text_groups
from tidemark.llm.files import listed, located, read_range, write_whole
from tidemark.llm.shared import text_key, trim

BLOCK = 512
PERCENTILE = 0.95
FILE_TOKENS = 4_000_000
MAGIC = b"TMKPFOR1"
HEAD = "<IBxH"  # minimum, width, exceptions
FOOTER = "<qqqqqqq8s"  # part, seq, ids, documents, blocks, start of documents, start of block starts, magic
HEAD_SIZE, FOOTER_SIZE = struct.calcsize(HEAD), struct.calcsize(FOOTER)
WORDS = BLOCK // 64


def bit_widths(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack_rows(x: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values below 2**width -> (blocks, words) little-endian 64-bit words."""
    lanes = np.ascontiguousarray(x.T.astype(np.uint64))
    out = np.zeros((WORDS * width, x.shape[0]), np.uint64)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack_rows(words: np.ndarray, width: int) -> np.ndarray:
    """Inverse of ``pack_rows``."""
    lanes = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, words.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        v = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (lanes[word + 1] << np.uint64(64 - shift))
        out[i] = v & mask
    return out.T


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[list[bytes], np.ndarray]:
    """The blocks of an id array and their lengths in bytes."""
    if not len(ids):
        return [], np.zeros(0, np.int64)
    n = -(-len(ids) // BLOCK)
    x = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1], ids.dtype)]).reshape(n, BLOCK).astype(np.int64)
    low = x.min(axis=1)
    x -= low[:, None]
    rank = max(int(np.ceil(percentile * BLOCK)) - 1, 0)
    width = bit_widths(np.partition(x, rank, axis=1)[:, rank])
    large = x >= (np.int64(1) << width)[:, None]
    rows, cols = np.nonzero(large)
    outliers = x[rows, cols].astype("<u4")
    x[rows, cols] = 0
    counts = np.bincount(rows, minlength=n)
    ends = np.cumsum(counts)
    body: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        for i, row in zip(own.tolist(), pack_rows(x[own], w).astype("<u8"), strict=True):
            body[i] = row.tobytes()
    places = cols.astype("<u2")
    blocks = [
        struct.pack(HEAD, int(low[i]), int(width[i]), int(counts[i])) + body[i] + places[e - c : e].tobytes() + outliers[e - c : e].tobytes()
        for i, (c, e) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True))
    ]
    return blocks, np.array([len(b) for b in blocks], np.int64)


def unpack_blocks(raw: bytes, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """Ids of consecutive blocks that begin at ``starts`` in ``raw``."""
    data = np.frombuffer(raw, np.uint8)
    heads = data[starts[:, None] + np.arange(HEAD_SIZE)]
    low = np.ascontiguousarray(heads[:, :4]).view("<u4")[:, 0].astype(np.int64)
    width = heads[:, 4].astype(np.int64)
    counts = np.ascontiguousarray(heads[:, 6:8]).view("<u2")[:, 0].astype(np.int64)
    out = np.empty((len(starts), BLOCK), np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        words = data[(starts[own] + HEAD_SIZE)[:, None] + np.arange(WORDS * w * 8)]
        out[own] = unpack_rows(np.ascontiguousarray(words).view("<u8"), w).astype(np.int64)
    if counts.sum():
        block = np.repeat(np.arange(len(starts)), counts)
        rank = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
        places = (starts + HEAD_SIZE + WORDS * 8 * width)[block]
        col = data[(places + 2 * rank)[:, None] + np.arange(2)]
        val = data[(places + 2 * counts[block] + 4 * rank)[:, None] + np.arange(4)]
        out[block, np.ascontiguousarray(col).view("<u2")[:, 0]] = np.ascontiguousarray(val).view("<u4")[:, 0]
    out += low[:, None]
    return out.reshape(-1)[:n_ids].astype("<u4")


def file_bytes(part: int, seq: int, ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> Iterator[bytes]:
    blocks, sizes = pack_blocks(ids)
    yield MAGIC
    yield from blocks
    docs = len(MAGIC) + int(sizes.sum())
    table = np.zeros(len(doc_ids), [("id", "<i8"), ("null", "u1"), ("n", "<i8")])
    table["id"] = [d or 0 for d in doc_ids]
    table["null"] = [d is None for d in doc_ids]
    table["n"] = lengths
    yield table.tobytes()
    starts = (len(MAGIC) + np.cumsum(sizes) - sizes).astype("<i8")
    yield starts.tobytes()
    yield struct.pack(FOOTER, part, seq, len(ids), len(doc_ids), len(blocks), docs, docs + table.nbytes, MAGIC)


def read_footer(uri: str, length: int) -> dict[str, int]:
    part, seq, ids, docs, blocks, at_docs, at_starts, magic = struct.unpack(FOOTER, read_range(uri, length - FOOTER_SIZE, FOOTER_SIZE))
    if magic != MAGIC:
        raise ValueError(f"{uri} is no token file")
    return {"part": part, "seq": seq, "ids": ids, "docs": docs, "blocks": blocks, "at_docs": at_docs, "at_starts": at_starts}


def read_ids(uri: str, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count of a file; reads the block starts and the blocks that hold them."""
    store, path = located(uri)
    foot = read_footer(uri, store.get_file_info(path).size)
    count = max(min(count, foot["ids"] - start), 0)
    if not count:
        return np.zeros(0, "<u4")
    a, b = start // BLOCK, (start + count - 1) // BLOCK + 1
    starts = np.frombuffer(read_range(uri, foot["at_starts"] + 8 * a, 8 * (min(b + 1, foot["blocks"]) - a)), "<i8")
    end = int(starts[b - a]) if len(starts) > b - a else foot["at_docs"]
    raw = read_range(uri, int(starts[0]), end - int(starts[0]))
    ids = unpack_blocks(raw, starts[: b - a] - starts[0], min(b * BLOCK, foot["ids"]) - a * BLOCK)
    return ids[start - a * BLOCK : start - a * BLOCK + count]


def read_documents(uri: str, length: int) -> pd.DataFrame:
    """doc_id, local_start, n_tokens, ids_crc32 of a file's documents."""
    foot = read_footer(uri, length)
    raw = read_range(uri, 0, length - FOOTER_SIZE)
    table = np.frombuffer(raw, [("id", "<i8"), ("null", "u1"), ("n", "<i8")], foot["docs"], foot["at_docs"])
    ids = unpack_blocks(raw, np.frombuffer(raw, "<i8", foot["blocks"], foot["at_starts"]), foot["ids"])
    view = memoryview(ids).cast("B")
    ends = np.cumsum(table["n"])
    crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for n, e in zip(table["n"].tolist(), ends.tolist(), strict=True)]
    doc_ids = pd.array(table["id"], dtype="Int64")
    doc_ids[table["null"].astype(bool)] = pd.NA
    return pd.DataFrame(
        {"part": foot["part"], "seq": foot["seq"], "doc_id": doc_ids, "local_start": ends - table["n"], "n_tokens": table["n"], "ids_crc32": np.array(crcs, np.int64)}
    )


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode the documents and write token files to ``folder``. Returns path, part, seq, n_docs, n_tokens of the files; they are written when it is computed."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(vocabulary, special=True)
        part, seq = TaskContext.get().partitionId(), 0
        arrays: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def close() -> pd.DataFrame:
            nonlocal seq, held
            path = f"{folder}/tokens-{part:06d}-{seq:06d}.pfor"
            write_whole(path, file_bytes(part, seq, np.concatenate(arrays), doc_ids, lengths))
            row = pd.DataFrame({"path": [path], "part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_tokens": [held]})
            arrays.clear(), doc_ids.clear(), lengths.clear()
            seq, held = seq + 1, 0
            return row

        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"].tolist()
            for a, b in text_groups(texts):
                coded, ends = code.encode_closed(texts[a:b], end_id)
                at = done = 0
                for end, doc_id in zip(ends.tolist(), ids[a:b], strict=True):
                    doc_ids.append(None if doc_id is None else int(doc_id))
                    lengths.append(end - at)
                    held, at = held + end - at, end
                    if held >= file_tokens:
                        arrays.append(coded[done:end])
                        done = end
                        yield close()
                if done < len(coded):
                    arrays.append(coded[done:])
            trim()
        if doc_ids:
            yield close()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.withColumn("_h", text_key("text")).repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    # doc_id as text keeps nulls and all 64 bits through pandas
    sent = sent.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return sent.mapInPandas(write, "path string, part long, seq long, n_docs long, n_tokens long")


def token_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the files of a folder."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"], strict=True):
                yield read_documents(path, length)

    def foot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"], strict=True):
                f = read_footer(path, length)
                yield pd.DataFrame({"part": [f["part"]], "seq": [f["seq"]], "n": [f["ids"]]})

    files = listed(spark, folder, "*.pfor")
    feet = files.mapInPandas(foot, "part long, seq long, n long")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per file within its part, one row per part over all
    in_part = feet.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("in_part"))
    parts = feet.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("before"))
    bases = in_part.join(parts, "part").select("part", "seq", (F.col("in_part") + F.col("before")).alias("base"))
    docs = files.mapInPandas(read, "part long, seq long, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return docs.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
