"""Token files and separator scans against the plain tokenizer."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.llm import encoder, separator_scan, token_blocks
from tidemark.llm.encoder import Encoder
from tidemark.llm.files import located, read_range, write_whole
from tidemark.llm.queries import QUERIES, vocabulary
from tidemark.llm.shared import new_folder

SF_DIR = "/root/testdata/sf0.001"
HARD = [
    "", " ", "\n", "a", " a", "a ", "a\nb", "a \n b", "\n\n", "don't 's 's", "tab\tx\r\ny", "x  y", "é b c", "a <|endoftext|> b!", "日本語 テスト",
    "\n a", "a\n", "##  ### \n\n\nq", "1 2 3 '' 's", "a\x1cb \x85 c", "end., of. a,b .,", "x" * 5000, "a   b    ",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("special", [False, True])
def test_encoder_equals_library(special):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    plain.encode_special_tokens = not special
    draw = random.Random(1)
    signs = [" ", " ", "\n", "a", "b.", ",", "é", "Ġ", "<|endoftext|>", "\t", "1", "'s", "日"]
    texts = HARD + ["".join(draw.choices(signs, k=draw.randint(0, 12))) for _ in range(2000)]
    code = Encoder(vocabulary("byte_bpe_50k.json"), special=special)
    for _ in range(2):  # the second time all units are known
        ids, ends = code.encode(texts)
        for text, got in zip(texts, np.split(ids, ends[:-1]), strict=True):
            assert got.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_special_strings(plain):
    assert plain("a<|endoftext|>b") == [64, 50256, 65]
    assert Encoder(vocabulary("byte_bpe_50k.json"), special=True).encode(["a<|endoftext|>b"])[0].tolist() == [64, 50256, 65]


def test_forgotten_units_are_learned_again(monkeypatch):
    monkeypatch.setattr(encoder, "CACHE_UNITS", 10)
    code, whole = Encoder(vocabulary("byte_bpe_50k.json")), Encoder(vocabulary("byte_bpe_50k.json"))
    for k in range(5):
        texts = [f"w{i} und {i * k}, so.\nEnde{i}" for i in range(20)]
        assert (code.encode(texts)[0] == whole.encode(texts)[0]).all()


def test_recurring_units_stay_known(monkeypatch):
    """Units of every batch are encoded once, however many units of one batch come between."""
    monkeypatch.setattr(encoder, "CACHE_UNITS", 60)
    code, whole, learned = Encoder(vocabulary("byte_bpe_50k.json")), Encoder(vocabulary("byte_bpe_50k.json")), []
    learn = code.learn
    monkeypatch.setattr(code, "learn", lambda units: (learned.extend(units), learn(units)))
    for k in range(20):
        texts = [f"now here is what all of them hold and once{k}x{i}, again." for i in range(20)]
        assert (code.encode(texts)[0] == whole.encode(texts)[0]).all()
    assert learned.count("what") == learned.count("again") == 1
    assert len(learned) == len(set(learned)) and len(code.place) <= 60


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 20_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.04, rng.integers(0, 2**32 - 1, n), rng.integers(0, 50_000, n)).astype("<u4")
    blocks, sizes = token_blocks.pack_blocks(ids)
    assert (token_blocks.unpack_blocks(b"".join(blocks), np.cumsum(sizes) - sizes, n) == ids).all()


def test_range_read(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50_000, 5_000).astype("<u4")
    path = f"{tmp_path}/x.pfor"
    write_whole(path, token_blocks.file_bytes(3, 4, ids, [1, None], [2_000, 3_000]))
    for start, count in [(0, 5_000), (0, 1), (511, 2), (4_999, 9), (1_024, 512), (5_000, 3)]:
        assert (token_blocks.read_ids(path, start, count) == ids[start : start + count]).all()


def test_query_equals_plain_encoding(spark, plain):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    want, start = {}, 0
    for d in docs:
        ids = np.array([*plain(d.text), 0], "<u4")
        want[d.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op1_token_blocks"](spark, SF_DIR).collect()}
    assert got == want


def test_nulls_repeats_and_small_files(spark, plain):
    rows = [(5, "b c"), (None, "n"), (2, None), (2, ""), (7, "same"), (7, "same"), (9, "x " * 400)]
    docs = spark.createDataFrame([Row(doc_id=a, text=b, start=1, part="p") for a, b in rows], "doc_id long, text string, start int, part string")
    folder = new_folder(spark, "t")
    files = token_blocks.write_tokens(docs, folder, vocabulary("byte_bpe_50k.json"), file_tokens=3).collect()
    assert len(files) > 3
    got = token_blocks.token_documents(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 2, 5, 7, 7, 9]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert sorted(r.n_tokens for r in got) == sorted(len(plain(t)) + 1 for _, t in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = new_folder(spark, "t")
    store, path = located(folder)
    store.create_dir(path, recursive=True)
    assert token_blocks.write_tokens(docs, folder, vocabulary("byte_bpe_50k.json")).count() == 0
    assert token_blocks.token_documents(spark, folder).count() == 0
    assert separator_scan.count_tokens(spark, folder, 9).count() == 0


def test_separator_scan_across_ranges(spark):
    rng = np.random.default_rng(2)
    folder = new_folder(spark, "t")
    want = {}
    for name, n, closed in (("a.ids", 1_000, True), ("b.ids", 777, False), ("c.ids", 0, True), ("d.ids", 300, False)):
        ids = rng.integers(0, 30 if name != "d.ids" else 2, n).astype("<u2")
        if name == "d.ids":
            ids[:] = 3  # no separator at all
        if closed and n:
            ids[-1] = 0
        write_whole(f"{folder}/{name}", [ids.tobytes()])
        start = 0
        for k, at in enumerate([*np.flatnonzero(ids == 0).tolist(), *([n] if n and ids[-1] != 0 else [])]):
            want[name, k] = (start, at - start, at < n)
            start = at + 1
    for size in (2, 14, 100, 1 << 20):
        got = separator_scan.count_tokens(spark, folder, 0, range_bytes=size).collect()
        assert {(r.path.rsplit("/", 1)[1], r.ordinal): (r.start, r.n_tokens, r.closed) for r in got} == want


def test_separator_query(spark, plain):
    docs = {r.doc_id: len(plain(r.text)) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op9_separator_scan"](spark, SF_DIR).collect()} == docs


def test_flat_files_of_odd_rows(spark, plain):
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, ""), (1, "b c")], "doc_id long, text string").withColumn("path", F.lit("x"))
    folder = new_folder(spark, "t")
    names = separator_scan.write_flat(docs.coalesce(1), folder, vocabulary("byte_bpe_50k.json"), 50256).collect()
    assert [(r.ordinal, r.doc_id) for r in names] == [(0, None), (1, 1), (2, 1), (3, 1)]
    got = separator_scan.count_tokens(spark, folder, 50256).orderBy("ordinal").collect()
    assert [r.n_tokens for r in got] == [1, 0, 0, len(plain("b c"))]


def test_partial_id_is_an_error(spark):
    folder = new_folder(spark, "t")
    write_whole(f"{folder}/x.ids", [b"abc"])
    with pytest.raises(Exception, match="no whole number"):
        separator_scan.count_tokens(spark, folder, 0).collect()
    assert read_range(f"{folder}/x.ids", 1, 2) == b"bc"
