"""Language identification: held-out accuracy, kernel against its definition, edge cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_kernel as lk
from tidemark.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = QUERIES["op8_language_kernel"](spark, path).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97


def test_kernel_counts_common_grams():
    def grams(text):
        t = lk.code_points(text).tolist()
        return {tuple(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i] or t[i + n - 1]}

    a, b = "The cat, sat on 12 mats", "a cat sits"
    x = lk.presence([a, b], 1 << 40)[0]
    assert x.sum(1).tolist() == [len(grams(a)), len(grams(b))]
    assert lk.kernel(x, x)[0, 1] == pytest.approx(len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))))


def test_folded_scores_equal_nystrom_regression():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcd" if k % 2 else "bcde"), 60)) for k in range(40)]
    labels = ["x" if k % 2 else "y" for k in range(40)]
    model = lk.fit(texts, labels, landmarks=400, ridge=1e-3)  # all texts are landmarks: plain kernel ridge regression
    p = lk.presence(texts, 1 << 40)[0]
    k = lk.kernel(p, p)
    y = np.array([[lab == c for c in ("x", "y")] for lab in labels], float)
    c = np.eye(40) - 1 / 40
    kc = c @ k @ c
    want = k @ c @ np.linalg.solve(kc + 40 * 1e-3 * np.eye(40), c @ y)
    got = p @ model.weights / np.sqrt(p.sum(1))[:, None]
    assert np.abs((got - got.mean(0)) - (want - want.mean(0))).max() < 1e-3


def test_whole_texts_count():
    model = lk.fit(["aaab abba " * 9, "cddc dccd " * 9] * 4, ["l1", "l2"] * 4)
    assert lk.predict(model, ["aaab abba " * 400 + "cddc dccd " * 4000])[0] == ["l2"]


def test_edges(spark):
    rows = [(k, "bonjour le monde" if k % 2 else "guten tag welt", "fr" if k % 2 else "de") for k in range(40)]
    rows += [(50, None, "fr"), (51, "", "de"), (52, "123 !?", None), (None, "bonjour", "fr"), (53, "bonjour", None), (53, "bonjour", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "_judged": F.lit(1)})
    model = lk.learn(docs)
    assert model.languages == ["de", "fr"]
    out = lk.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "_judged", "lang_pred", "score"]
    got = [(r.doc_id, r.lang_pred) for r in out.where("doc_id >= 50 OR doc_id IS NULL").collect()]
    assert got == [(50, "und"), (51, "und"), (52, "und"), (None, "fr"), (53, "fr"), (53, "fr")]
    nothing = lk.learn(docs.limit(0))
    assert [(r.lang_pred, r.score) for r in lk.identify(docs.limit(1), nothing).collect()] == [("und", 0.0)]
    assert lk.identify(docs.limit(0), model).count() == 0


def test_long_texts_are_scored_in_blocks(monkeypatch):
    model = lk.fit(["aaab abba " * 9, "cddc dccd " * 9] * 4, ["l1", "l2"] * 4)
    texts = ["aaab abba " * 900 + "cddc dccd " * 700, "x", "cddc " * 30]
    whole = lk.score(model, texts)
    monkeypatch.setattr(lk, "PIECES", 3)
    assert np.allclose(lk.score(model, texts), whole, atol=1e-6)
