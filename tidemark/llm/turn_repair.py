"""Conversation structure repair by depth-first branch-and-bound.

The role initials of a sound conversation read ``(s?(ua)+)?``. Edits of a conversation's
turns: Keep (free), Rerole to user or assistant (2), Delete (3; blank and duplicate
turns must go), Insert an empty user or assistant turn (2); a truncated turn that stays costs 1 more.
Among the cheapest edits the one whose initials (the audit) are least in ASCII wins.

The search holds its open prefixes on an explicit stack, the most promising on top. A prefix is
given up when its cost plus a lower bound of the rest exceeds the incumbent
(cost, audit), or equals it with a later audit, or when the same node, turns read
and place in the grammar, was reached by a better prefix (dominance table). The bound is the least
cost of the rest in every place of the grammar, which leaves out the audit; so the first descent
ends in a cheapest repair and what remains is the proof. Time and memory grow with the turns.

Rows are dealt by conversation, sorted within partitions and streamed; a task holds the
turns of one conversation at a time.

Defined cases: null role and null text are one space; rows of a conversation go by turn
(null first), then role, then text; repeated rows are duplicates; a null conv_id is a
conversation; a text of any length must fit a task with the rest of its conversation;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
SOUND_PAIRS = {"su", "ua", "au"}

BEGIN, SYSTEM, USER, ASSISTANT = range(4)
READ = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
"""Place in the grammar after a turn with this role initial."""
PUT = (USER, USER, ASSISTANT, USER)
"""Place after the turn that a Rerole or Insert makes in each place."""
ROLE = {USER: "user", ASSISTANT: "assistant"}
CLOSED = (BEGIN, ASSISTANT)
DELETE, INSERT, KEEP, REROLE = "DIKR"
DELETE_COST, INSERT_COST, REROLE_COST = 3, 2, 2

Turn = tuple[str, bool, int]
"""Role initial, whether the turn must go, what it costs more if it stays."""


def row_moves(turn: Turn, place: int) -> list[tuple[str, int, int]]:
    """(edit, cost, place after) of the edits that read a turn."""
    initial, must_go, more = turn
    moves = [(DELETE, DELETE_COST, place)]
    if not must_go:
        if (place, initial) in READ:
            moves.append((KEEP, more, READ[place, initial]))
        moves.append((REROLE, REROLE_COST + more, PUT[place]))
    return moves


def suffix_bounds(turns: list[Turn]) -> list[list[int]]:
    """Least cost of the turns from each one on, for each place in the grammar before it."""

    def with_inserts(direct: list[int]) -> list[int]:
        user = min(direct[USER], INSERT_COST + direct[ASSISTANT])
        assistant = min(direct[ASSISTANT], INSERT_COST + direct[USER])
        return [min(direct[BEGIN], INSERT_COST + user), min(direct[SYSTEM], INSERT_COST + user), user, assistant]

    open_end = 2 * INSERT_COST + 1
    bounds = [with_inserts([0 if place in CLOSED else open_end for place in range(4)])]
    for turn in reversed(turns):
        after = bounds[-1]
        bounds.append(with_inserts([min(cost + after[to] for _, cost, to in row_moves(turn, place)) for place in range(4)]))
    return bounds[::-1]


def precedes(a: tuple, b: tuple) -> bool:
    """Whether the audit of node a comes before that of node b; nodes are (parent, edit, depth). A beginning of b does not."""
    while a[2] > b[2]:
        a = a[0]
    while b[2] > a[2]:
        b = b[0]
    if a is b:
        return False
    while a[0] is not b[0]:
        a, b = a[0], b[0]
    return a[1] < b[1]


def cheapest_repair(turns: list[Turn]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, the least audit among equal ones."""
    bounds = suffix_bounds(turns)
    root = (None, "", 0)
    stack = [(0, BEGIN, 0, root)]
    reached: dict[tuple[int, int], tuple[int, tuple]] = {}
    cost_found, path_found = None, []

    def worse(cost: int, node: tuple, known_cost: int, known: tuple) -> bool:
        return known_cost < cost or (known_cost == cost and not precedes(node, known))

    while stack:
        read, place, cost, node = stack.pop()
        if cost_found is not None and worse(cost + bounds[read][place], node, cost_found, path_found[min(node[2], len(path_found) - 1)]):
            continue
        known = reached.get((read, place))
        if known is not None and worse(cost, node, *known):
            continue
        reached[read, place] = (cost, node)
        if read == len(turns) and place in CLOSED:
            cost_found, path_found = cost, [node] * (node[2] + 1)
            while node[0] is not None:
                node = node[0]
                path_found[node[2]] = node
            continue
        moves = [(INSERT, INSERT_COST, read, PUT[place])]
        if read < len(turns):
            moves += [(edit, more, read + 1, to) for edit, more, to in row_moves(turns[read], place)]
        open_ = [(cost + more + bounds[at][to], edit, at, to, cost + more) for edit, more, at, to in moves]
        for _, edit, at, to, total in sorted(open_, reverse=True):
            stack.append((at, to, total, (node, edit, node[2] + 1)))
    return cost_found, "".join(node[1] for node in path_found)


def apply_edits(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The repaired (role, text) turns an audit describes."""
    out, place, rest = [], BEGIN, iter(rows)
    for edit in audit:
        if edit == INSERT:
            place = PUT[place]
            out.append((ROLE[place], ""))
            continue
        role, text = next(rest)
        if edit == DELETE:
            continue
        place = PUT[place] if edit == REROLE else READ[place, role[:1]]
        out.append((ROLE[place] if edit == REROLE else role, text))
    return out


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """First fault of each turn: blank, duplicate, truncated or none (empty)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(BLANKS)
        mark = (role, len(text), hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        out.append("blank" if not bare else "duplicate" if mark in seen else "truncated" if bare[-1] not in ENDS else "")
        seen.add(mark)
    return out


def repaired(turns: list[int | None], rows: list[tuple[str, str]]) -> dict:
    """The report of one conversation, its rows in order."""
    kinds = faults(rows)
    cost, audit = cheapest_repair([(role[:1], kind in ("blank", "duplicate"), int(kind == "truncated")) for (role, _), kind in zip(rows, kinds, strict=True)])
    known = {t for t in turns if t is not None}
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "blank": kinds.count("blank"),
        "duplicate": kinds.count("duplicate"),
        "truncated": kinds.count("truncated"),
        "illegal": sum(a[:1] + b[:1] not in SOUND_PAIRS for (a, _), (b, _) in zip(rows, rows[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired": [{"role": role, "text": text} for role, text in apply_edits(rows, audit)],
    }


def repair_conversations(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (array of role, text).

    Rows where ``present`` is not true only name their conversation, which may be left without turns.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    slim = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), here.alias("_here"))
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([("conv_id", to_arrow_type(id_type)), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired", turn_type)])
        at, open_, turns, texts = None, False, [], []

        def report() -> dict:
            return {"conv_id": at} | repaired(turns, texts)

        for batch in batches:
            done = []
            for conv, turn, role, text, is_here in zip(*[batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "_here")], strict=True):
                if not open_ or conv != at:
                    if open_:
                        done.append(report())
                    at, open_, turns, texts = conv, True, [], []
                if is_here:
                    turns.append(turn)
                    texts.append((role, text))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if open_:
            yield pa.RecordBatch.from_pylist([report()], schema)

    id_type = rows.schema["conv_id"].dataType
    longs = ", ".join(f"{c} long" for c in counts)
    return dealt.mapInArrow(work, f"conv_id {kind}, {longs}, audit string, repaired array<struct<role:string,text:string>>")


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Test damage by crc32 of ``conv_id:turn`` modulo 20 (0 drops, 1 empties, 2 takes sentence ends, 3 repeats, 4 makes user), and which rows are left."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    role, text = space("role"), space("text")
    marked = rows.select(
        "conv_id", "turn",
        F.when(what == 4, "user").otherwise(role).alias("role"),
        F.when(what == 1, "").when(what == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        what.alias("_what"),
    )
    copies = F.when(F.col("_what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("_copy", F.explode(copies)), F.col("_what") != 0
