"""Conversation repair against all edit sequences, and its damage and report against direct ones."""

from __future__ import annotations

import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import turn_repair
from tidemark.llm.queries import QUERIES

SOUND = re.compile("(s?(ua)+)?")


def all_repairs(turns):
    """Cheapest (cost, audit) among all edits with up to two inserts at each place."""
    slots = [[""], ["u", "a"], ["uu", "ua", "au", "aa"]]
    inserts = [x for level in slots for x in level]
    options = []
    for initial, must_go, more in turns:
        o = [("D", 3, "")]
        if not must_go:
            o += [("K", more, initial or "?"), ("R", 2 + more, "u"), ("R", 2 + more, "a")]
        options.append(o)
    best = None
    for edits in itertools.product(*options):
        base = sum(e[1] for e in edits)
        for put in itertools.product(inserts, repeat=len(turns) + 1):
            cost = base + 2 * sum(map(len, put))
            if best is not None and cost > best[0]:
                continue
            made = put[0] + "".join(e[2] + p for e, p in zip(edits, put[1:], strict=True))
            if SOUND.fullmatch(made):
                audit = "I" * len(put[0]) + "".join(e[0] + "I" * len(p) for e, p in zip(edits, put[1:], strict=True))
                best = min(best or (cost, audit), (cost, audit))
    return best


@pytest.mark.parametrize("seed", range(60))
def test_equals_all_edits(seed):
    draw = random.Random(seed)
    turns = []
    for _ in range(draw.randint(0, 4)):
        gone = draw.random() < 0.2
        turns.append((draw.choice(["s", "u", "u", "a", "a", "x", ""]), gone, int(not gone and draw.random() < 0.3)))
    assert turn_repair.cheapest_repair(turns) == all_repairs(turns)


def by_table(turns):
    """Cheapest (cost, audit) by a table over places, turn after turn."""
    places = {0: (0, "")}

    def with_inserts(table):
        for _ in range(2):
            for place, (cost, audit) in list(table.items()):
                new = (cost + 2, audit + "I")
                to = turn_repair.PUT[place]
                table[to] = min(table.get(to, new), new)
        return table

    for turn in turns:
        after = {}
        for place, (cost, audit) in with_inserts(places).items():
            for edit, more, to in turn_repair.row_moves(turn, place):
                new = (cost + more, audit + edit)
                after[to] = min(after.get(to, new), new)
        places = after
    return min(v for place, v in with_inserts(places).items() if place in turn_repair.CLOSED)


@pytest.mark.parametrize("n", [40, 400])
def test_long_conversations(n):
    for seed in range(5):
        draw = random.Random(seed)
        turns = []
        for _ in range(n):
            gone = draw.random() < 0.15
            turns.append((draw.choice("suaax"), gone, int(not gone and draw.random() < 0.3)))
        assert turn_repair.cheapest_repair(turns) == by_table(turns)


def test_very_long_conversation_ends():
    draw = random.Random(1)
    turns = [(draw.choice("suax"), draw.random() < 0.1, 0) for _ in range(100_000)]
    cost, audit = turn_repair.cheapest_repair(turns)
    assert sum(e != "I" for e in audit) == len(turns)
    assert cost == turn_repair.suffix_bounds(turns)[0][turn_repair.BEGIN]


SCHEMA = "conv_id long, turn long, role string, text string, cost string"


def test_defined_cases(spark):
    rows = [
        (1, 0, "user", "Hi.", "x"), (1, 1, "assistant", "Yes.", "x"),
        (2, None, "assistant", "Late", "x"), (2, 5, "user", " \t", "x"), (2, 5, "user", " \t", "x"), (2, 9, None, None, "x"),
        (None, 3, "user", "Well?", "x"), (None, 4, "user", "Well?", "x"), (None, 7, "", "a." + "b" * 200_000 + "!", "x"),
        (4, None, "user", "One", "x"),
        (5, 1, "user", "Only named.", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r for r in turn_repair.repair_conversations(df, F.col("cost").isNotNull()).collect()}
    assert set(got) == {1, 2, None, 4, 5}
    assert (got[1]["cost"], got[1]["audit"], got[1]["illegal"], got[1]["gaps"]) == (0, "KK", 0, 0)
    assert [(t["role"], t["text"]) for t in got[1]["repaired"]] == [("user", "Hi."), ("assistant", "Yes.")]
    # the late turn is cut off; two blank ones and the null one go
    assert (got[2]["blank"], got[2]["duplicate"], got[2]["truncated"], got[2]["gaps"], got[2]["illegal"]) == (3, 0, 1, 3, 2)
    assert (got[None]["duplicate"], got[None]["gaps"]) == (1, 2)
    assert (got[4]["gaps"], got[4]["truncated"]) == (0, 1)
    assert (got[5]["cost"], got[5]["audit"], got[5]["repaired"], got[5]["gaps"]) == (0, "", [], 0)
    for r in got.values():
        assert SOUND.fullmatch("".join(t["role"][:1] for t in r["repaired"]))


def test_empty_table(spark):
    assert turn_repair.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_damage(spark):
    rows = [(i, j, "assistant", "A. b?", "x") for i in range(30) for j in range(3)] + [(None, None, None, None, "x")]
    made, present = turn_repair.damaged(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in made.where(present).collect() if r["conv_id"] is not None)
    want = []
    for conv, turn, role, text, _ in rows[:-1]:
        what = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else "A b" if what == 2 else text
        want += [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    assert got == sorted(want)


def test_query_names_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    assert QUERIES["op12_turn_repair"](spark, sf).count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
