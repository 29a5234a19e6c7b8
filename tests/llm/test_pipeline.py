"""The pipeline against brute-force versions of its stages, each on its own input."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import line_templates, order_minhash
from tidemark.llm.shared import new_folder

SF_DIR = "/root/testdata/sf0.001"


def test_stages_on_their_own_input(spark):
    from test_order_minhash import brute as classes
    from test_phrase_index import brute as leaks

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        folder = new_folder(spark, "stage")
        stage(spark, docs, SF_DIR).write.parquet(folder)
        docs = spark.read.parquet(folder)
        after = {r.doc_id: r for r in docs.collect()}
        seen[name] = after
        assert docs.columns[: len(columns)] == columns
        if name == "language_id":
            assert len(after) == len(before)
        elif name == "line_dedup":
            want = line_templates.drop_recurring(spark.createDataFrame(list(before.values()), docs.schema), min_docs=corpus_pipeline.LINE_DOCS)
            assert {k: r.text for k, r in after.items()} == {r.doc_id: r.text for r in want.collect() if r.n_dropped == 0 or r.text.strip()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            cls = classes([(k, r.text) for k, r in before.items()])
            assert set(after) == set(cls.values())
        elif name == "decontamination":
            hit = {d for d, _, n, _ in leaks([(k, r.text) for k, r in before.items()], items) if n}
            assert set(after) == set(before) - hit and hit
        else:
            assert set(after) == set(before) and all(r.lossless and r.decoded == r.text and r.piece_ids for r in after.values())
    run = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id: r.piece_ids for r in run.select("doc_id", "piece_ids").collect()} == {k: r.piece_ids for k, r in seen["pieces"].items()}


def test_passages_in_few_unlike_documents(spark):
    """A passage in 2 or 9 unlike documents stays in the first alone; near copies stay whole until one of them is chosen."""
    text = lambda k, n: " ".join(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(n))
    rows = [(k, text(k, 70) + "\n" + text(90, 55)) for k in range(9)] + [(20 + k, text(20 + k, 70) + "\n" + text(91, 55)) for k in range(2)]
    whole = "\n".join(text(40 + k, 30) for k in range(5))
    rows += [(50, whole), (51, whole + " end"), (52, whole)]
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id long, text string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        folder = new_folder(spark, name)
        stage(spark, docs, SF_DIR).write.parquet(folder)
        docs = spark.read.parquet(folder)
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == {k: t if k in (0, 20, 50) else t.split("\n")[0] for k, t in rows if k not in (51, 52)}
    assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (4, "the cat and the dog", "en", "s", 19),
        (4, "the cat and the dog", "en", "s", 19), (5, "le chat et le chien", "fr", None, None), (None, "the cat and the bird", "en", "s", 20), (6, "the sea " * 30_000, "en", "s", 240_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {"key": F.lit("k"), "score": F.lit(9.0), "matches": F.lit("m"), "piece_ids": F.lit("p"), "n_hit": F.lit("h")}
    )
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, SF_DIR)
            rows_out = out.collect()
            if k < 4:
                assert out.columns == docs.columns
        if k == 0:
            kept = stage(spark, docs, SF_DIR)
            assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "5", "6", "None"]
        assert len(rows_out) == 0
    assert order_minhash.near_classes(docs).count() > 0
