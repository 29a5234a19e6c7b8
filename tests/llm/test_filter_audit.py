"""The filter audit against documents filtered one by one in every order."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

from tidemark.llm import filter_audit, shared

DOCS = "doc_id long, text string, source string, kept string"
LABELS = "doc_id long, quality int, toxic int"


def failures(rows):
    out = []
    for doc_id, text, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(words) < 50:
            f.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == t for o in rows):
            f.add("E")
        out.append(f)
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = failures(rows)
    out, removed_by = {}, defaultdict(int)
    for part in {r[2] or "" for r in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = set(own)
            for step, name in enumerate(order, 1):
                here = {i for i in left if name in fails[i]}
                redundant = sum(name in fails[i] for i in own) - len(here)
                left -= here
                removed_by[part, name] += len(here)
                out[part, order, step] = (
                    len(left), len(here), redundant, sum(fails[i] == {name} for i in own),
                    sum(rows[i][0] in good for i in here), sum(rows[i][0] in toxic for i in here),
                )
    return {k: v + (removed_by[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def found(spark, rows, labels):
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()}


def made_rows():
    draw = random.Random(4)
    words = ["kala", "Mira", "ó x", "so", "UP", "a$b", "x\x1cy", "n m", "#", "ta"] + [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        n = draw.choice([0, 3, 49, 50, 51, 120])
        pool = words if draw.random() < 0.4 else words[10:]
        text = draw.choice([" ", "\n", "\t\x0b  "]).join(draw.choice(pool[: draw.choice([15, 90])]) for _ in range(n))
        rows.append((i, draw.choice(["", " "]) + text, draw.choice(["a", "b", None, ""]), "x"))
    for i in range(120, 160):  # copies, also of empty texts and with null ids
        rows.append((draw.choice([i, None, 3]), rows[draw.randrange(120)][1], draw.choice(["a", "c"]), "x"))
    return rows + [(200, None, "a", "x"), (201, "", "a", "x"), (201, "", "a", "x"), (202, "Wort " * 60_000, None, "x")]


def test_equals_brute_force(spark):
    rows = made_rows()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 170, 2)] + [(4, 1, 0), (None, 1, 1), (8, None, None)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    assert found(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    rows = made_rows()[:5]
    assert found(spark, rows, []) == brute(rows, [])


def test_copies_of_hot_and_rare_texts(spark, monkeypatch):
    monkeypatch.setattr(shared, "LEAST_HOT", 3)
    rows = [(i, "same text", "a", "x") for i in range(60)] + [(100 + i, f"pair {i // 2}", "a", "x") for i in range(8)]
    assert found(spark, rows, []) == brute(rows, [])


def test_shards_hold_the_matrix(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "coalesce(source, '') AS part", "text")
    shards = filter_audit.term_shards(docs, shard_bytes=500).cache()
    assert shards.count() > 20
    terms, seed = filter_audit.term_dictionary(shards)
    words = {w for _, t, *_ in rows for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}
    assert {r["word"] for r in terms.collect()} == words
    got = sorted((r["n_words"], r["n_distinct"]) for r in filter_audit.row_totals(filter_audit.encoded(shards, seed)).collect())
    found_words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    assert got == sorted((len(w), len(set(w))) for w in found_words)
    shards.unpersist()
