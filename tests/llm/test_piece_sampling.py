"""Sampled segmentations: lossless, reproducible, and distributed as the lattice says."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import piece_sampling
from tidemark.llm.queries import QUERIES, vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
HARD = ["", " ", "  ", "a", " a", "a ", "a  b", "  a  b\nc ▁ d ", "\n\n", "日本語 テスト 🎉", "x\x00y", "▁▁ ▁", "a   ", "tab\tx", "   ", "z" * 3000]


def test_lossless_and_independent_of_the_batch():
    p = piece_sampling.Pieces(MODEL)
    together = piece_sampling.sample(p, HARD, np.arange(len(HARD)))
    for i, (text, ids) in enumerate(zip(HARD, together, strict=True)):
        assert piece_sampling.decode_ids(p, ids) == text
        assert piece_sampling.sample(p, [text], np.array([i]))[0].tolist() == ids.tolist()


def test_library_decodes_the_pieces():
    from sentencepiece import SentencePieceProcessor

    p, sp = piece_sampling.Pieces(MODEL), SentencePieceProcessor(model_file=MODEL)
    for text in ["hello world", "é  x\ny", "日本"]:
        assert sp.decode(piece_sampling.sample(p, [text], np.array([4]))[0].tolist()) == text


def test_frequencies_equal_path_probabilities():
    from sentencepiece import SentencePieceProcessor

    p, sp = piece_sampling.Pieces(MODEL), SentencePieceProcessor(model_file=MODEL)
    names = {sp.id_to_piece(i): i for i in range(259, sp.get_piece_size())}
    word, alpha, paths = "▁theat", 0.7, {}

    def extend(at: int, path: tuple[int, ...], weight: float) -> None:
        if at == len(word):
            paths[path] = weight
        for end in range(at + 1, len(word) + 1):
            if (i := names.get(word[at:end])) is not None:
                extend(end, (*path, i), weight - alpha * p.log_rank[i])

    extend(0, (), 0.0)
    total = sum(map(math.exp, paths.values()))
    n = 40_000
    got = Counter(tuple(x.tolist()) for x in piece_sampling.sample(p, ["theat"] * n, np.arange(n), alpha))
    assert set(got) <= set(paths)
    assert max(abs(got[k] / n - math.exp(v) / total) for k, v in paths.items()) < 0.02


def test_columns_nulls_and_seeds(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, None), (None, "a b"), (4, "")], "doc_id long, text string")
    docs = docs.withColumns({"piece_ids": F.lit("old"), "decoded": F.lit(1), "_carry0": F.lit(2)})
    out = piece_sampling.decode(piece_sampling.encode(docs, MODEL), MODEL)
    assert out.columns == ["doc_id", "text", "_carry0", "piece_ids", "decoded"]
    rows = out.collect()
    assert all(r.decoded == r.text for r in rows)
    assert rows[0].piece_ids == rows[1].piece_ids and rows[3].piece_ids is None and rows[5].piece_ids == []
    again = piece_sampling.encode(docs.repartition(5), MODEL).where("doc_id = 1").first()
    assert again.piece_ids == rows[0].piece_ids
    other = piece_sampling.encode(docs, MODEL, seed=1).where("doc_id = 1").first()
    assert other.piece_ids != rows[0].piece_ids
    assert piece_sampling.decode(piece_sampling.encode(docs.limit(0), MODEL), MODEL).count() == 0


def test_query_is_lossless_and_computes_each_function_once(spark):
    out = QUERIES["op2_piece_sampling"](spark, "/root/testdata/sf0.001")
    assert out.where("NOT lossless").count() == 0 and out.count() == 200
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2


def test_decoding_in_the_same_pass(spark):
    docs = spark.createDataFrame([(1, "ein Wort, 日本 und\nmehr"), (2, None), (3, ""), (4, "  x ")], "doc_id long, text string").withColumn("decoded", F.lit(1))
    got = {r.doc_id: (r.piece_ids, r.decoded) for r in piece_sampling.encode(docs, MODEL, decoded=True).collect()}
    want = {r.doc_id: (r.piece_ids, r.decoded) for r in piece_sampling.decode(piece_sampling.encode(docs, MODEL), MODEL).collect()}
    assert got == want and [got[k][1] for k in (1, 2, 3, 4)] == ["ein Wort, 日本 und\nmehr", None, "", "  x "]
