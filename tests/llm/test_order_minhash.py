"""Near copies against brute force over all pairs; alignment against the full table."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import order_minhash as om
from tidemark.llm import shared
from tidemark.llm.components import components
from tidemark.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def longest(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    return int(t[-1, -1])


def brute(rows):
    """doc_id -> smallest doc_id of its class, from all pairs."""
    grams = [om.shingles(om.word_hashes(t or "")).tolist() for _, t in rows]
    cls = {d: d for d, _ in rows}
    links = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = grams[i], grams[j]
            if rows[i][1] and rows[i][1] == rows[j][1]:
                links.append((rows[i][0], rows[j][0]))
            elif a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(set(a) & set(b)) * 2 >= len(set(a)):
                m = longest(a, b)
                if m / (len(a) + len(b) - m) >= 0.8:
                    links.append((rows[i][0], rows[j][0]))
    for _ in rows:
        for a, b in links:
            cls[a] = cls[b] = min(cls[a], cls[b])
    return cls


def test_words_are_the_regex_words():
    for t in ["", "A b", " é, Foo-bar 12", "...", "a\x00b Ünï", "x" * 70 + " yy"]:
        lower = t.translate({i: i + 32 for i in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        assert om.word_hashes(t).tolist() == [int(om.word_hashes(w)[0]) for w in words]


@pytest.mark.parametrize("kinds", [2, 5, 1000])
def test_alignment(kinds):
    rng = np.random.default_rng(kinds)
    for _ in range(60):
        a = rng.integers(0, kinds, rng.integers(1, 50)).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 6)):
            b = np.insert(b, rng.integers(0, len(b) + 1), rng.integers(0, kinds)) if rng.random() < 0.5 or len(b) < 2 else np.delete(b, rng.integers(0, len(b)))
        m = longest(a, b)
        s = m / (len(a) + len(b) - m)
        assert om.similarity(a, b) == (pytest.approx(s) if s >= 0.8 else 0)


def edited(words, rng, edits):
    out = list(words)
    for k in rng.choice(len(out), edits, replace=False):
        out[k] = f"new{rng.integers(1e9)}"
    return " ".join(out)


@pytest.mark.parametrize(("small", "tile"), [(32, 256), (1, 5)])
def test_against_brute_force(spark, small, tile):
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(4):
        base = [f"w{rng.integers(1e6)}" for _ in range(150)]
        rows += [(len(rows) + k, edited(base, rng, int(rng.integers(0, 6)))) for k in range(12)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(500 + k, passage + " " + " ".join(f"q{rng.integers(1e6)}" for _ in range(80))) for k in range(10)]  # shared passage, not copies
    rows += [(600, "One two"), (601, "one, TWO!"), (602, ""), (603, None), (604, "..."), (605, "..."), (606, "!!"), (607, ""), (608, "a " * 300), (609, "a " * 310)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep": F.lit(1), "n": F.lit("x"), "key": F.lit(2.0)})
    got = {r.doc_id: r.class_id for r in om.near_classes(docs, small=small, tile=tile).collect()}
    assert got == brute(rows)
    kept = om.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v for v in got.values()})


@pytest.mark.parametrize(("small", "tile"), [(32, 256), (1, 5)])
def test_short_texts_that_differ_by_one_end_word(spark, small, tile):
    rows = []
    for n in range(8, 21):
        words = [f"t{n}x{k}" for k in range(n)]
        rows += [(100 * n, " ".join(words)), (100 * n + 1, " ".join([*words, "more"])), (100 * n + 2, " ".join(["else", *words[1:]])), (100 * n + 3, " ".join([*words[:-1], "else"]))]
    rows += [(9000 + k, f"all rights are reserved by the holder {k} of {k} a{k} b{k} c{k}") for k in range(40)]  # common shingles, not copies
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in om.near_classes(docs, small=small, tile=tile).collect()}
    assert got == brute(rows)
    assert all(got[100 * n + 1] == got[100 * n] for n in range(8, 21))


def test_tiles_link_pairs_at_exactly_the_threshold(spark):
    rows, want = [], {}
    for k, (n, m, common) in enumerate([(13, 14, 12), (49, 50, 44), (27, 27, 24), (200, 205, 180)]):
        grams = [np.append(np.arange(common), 1000 * j + np.arange(size - common)).astype(np.uint64) for j, size in ((1, n), (2, m))]
        assert om.similarity(*grams) == 0.8
        rows.append(([10 * k], [grams[0].tobytes()], [10 * k + 1], [grams[1].tobytes()]))
        rows.append(([10 * k + 2, 10 * k + 3], [g.tobytes() for g in grams], None, None))
        want |= {10 * k: 10 * k + 1, 10 * k + 2: 10 * k + 3}
    tiles = spark.createDataFrame(rows, "reps array<long>, grams array<binary>, reps2 array<long>, grams2 array<binary>")
    assert {r.a: r.b for r in om.tile_links(tiles, 0.8).collect()} == want


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (5, text + " end"), (5, "other words entirely here now"), (7, "other words entirely here now")], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in om.near_classes(docs).collect()}
    assert got == {3: 3, 5: 3, 7: 3}  # doc 5 stands for both texts
    assert sorted(str(r.doc_id) for r in om.drop_near_copies(docs).collect()) == ["3", "3", "None"]
    assert om.near_classes(docs.limit(0)).count() == 0 and om.drop_near_copies(docs.limit(0)).count() == 0


def test_stored_tables_end_once_classes_are_known(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, edited(base, rng, 1)) for k in range(40)] + [(40 + k, f"alone {k} " + " ".join(f"x{k}y{j}" for j in range(60))) for k in range(20)]
    monkeypatch.setattr(shared, "shared_folder", lambda _: f"{tmp_path}/a b")
    kept = om.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {name: sum(spark.read.parquet(str(f)).count() for f in (tmp_path / "a b").glob(f"{name}-*")) for name in ("marked", "reps", "sketches", "shingles", "gone")}
    assert left == {"marked": 0, "reps": 0, "sketches": 0, "shingles": 0, "gone": 39}
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(40, 60)]


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in QUERIES["op4_order_minhash"](spark, SF_DIR).collect()} == brute(rows)


def test_links_are_stored(spark):
    """What reads the links runs its own Python workers; unstored ones would hold a second one in each task."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(k, f"{text} end{k}") for k in range(40)] + [(50, "a b c d e f g h i"), (51, "a b c d e f g h j")], "doc_id long, text string")
    marked = om.sketch_documents(docs).withColumnRenamed("doc_id", "rep")
    for part in (docs, docs.where("doc_id >= 30")):
        links, _ = om.near_links(part, marked.join(part, F.col("rep") == F.col("doc_id"), "left_semi"), om.THRESHOLD, om.SMALL, om.TILE)
        assert "MapInPandas" not in links._jdf.queryExecution().toString()
        assert links.count() >= part.count() - 3
