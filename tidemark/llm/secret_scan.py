"""Secret scans: fixed patterns plus windows of high Shannon entropy. DataFrame functions only.

Candidate strings are maximal runs of key characters. A window of fixed length
slides over each; per step one character enters the counts and one leaves, so
sum(c log2 c) changes by four table values. Candidates consisting of hex digits
are judged by the hex threshold, others by the base-64 threshold. Allow-listed
strings (plain words, plain numbers, UUIDs, runs of one sign) are passed over, as
are windows that overlap a span of a fixed pattern. The hot windows left that overlap or touch
each other make one span, so what stands beside a fixed pattern is found.

Defined cases: null text is empty; empty text and an empty table have no span; equal rows give equal
results; spans of a text are ordered by start, then kind; a text of any length is searched whole and must fit a task; other columns are
carried along untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.llm.shared import carried, upto

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}+"
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE = 8
SIZE = 20
HEX_BITS, BASE64_BITS = 3.05, 3.78
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
ALLOWED = (
    r"^[=_/+-]*(?:[A-Za-z](?:[a-z]*|[A-Z]*)[=_/+-]+)*(?:[A-Za-z](?:[a-z]*|[A-Z]*))?$",  # words of one case after the first letter, also joined ones
    r"^[0-9=_/+-]+$",  # numbers and dates
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^(.)\1+$",  # rules and fillers
)
SPAN = "struct<start:bigint,kind:int,end:bigint>"
BLOCK = 64


def running_totals(values: Column) -> Column:
    """Inclusive running sums of an int array, in blocks, so long arrays stay cheap."""

    def by_blocks(v: Column) -> Column:
        blocks = F.transform(upto(F.ceil(F.size(v) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))

        def put(bs: Column) -> Column:
            total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
            sums = F.transform(bs, total)
            placed = let(
                sums,
                lambda t: F.transform(
                    bs, lambda block, b: let(total(F.slice(t, 1, b)), lambda before: F.transform(block, lambda _, i: before + total(F.slice(block, 1, i + 1))))
                ),
            )
            return F.flatten(placed)

        return let(blocks, put)

    return let(values, by_blocks)


def occurrences(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Spans of all matches, in code points: matches and the gaps between them add up to positions.

    ``keep`` are flags for the matches, in order.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    flags = keep if keep is not None else F.transform(found, lambda _: F.lit(True))

    def place(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        own = F.transform(m, F.length)
        ends = running_totals(F.zip_with(F.slice(gaps, 1, F.size(m)), own, lambda a, b: a + b))
        spans = F.zip_with(ends, own, lambda e, n: F.struct((e - n).cast("long").alias("start"), F.lit(kind).alias("kind"), e.cast("long").alias("end")))
        kept = F.zip_with(spans, flags, lambda s, f: F.when(f, s))
        return F.when(F.size(m) > 0, F.filter(kept, lambda s: s.isNotNull())).otherwise(F.array().cast(f"array<{SPAN}>"))

    return let(found, place)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and kind."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = F.transform(values, lambda v: F.length(v) >= MIN_VALUE)
    return F.array_sort(F.concat(occurrences(text, ASSIGN, 0, long_enough), occurrences(text, ACCESS, 1), occurrences(text, HEX, 2)))


def entropy_hits(candidate: Column, taken: Column, size: int = SIZE, hex_bits: float = HEX_BITS, base64_bits: float = BASE64_BITS) -> Column:
    """(first, last) window starts of the stretches of hot windows: at or above the threshold of the candidate's character class, clear of ``taken`` (start, end)."""
    table = [0.0] + [c * math.log2(c) for c in range(1, size + 2)]
    weights = F.array(*[F.lit(v) for v in table])
    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    limit = F.when(candidate.rlike("^[0-9a-fA-F]+$"), F.lit(hex_bits)).otherwise(F.lit(base64_bits))
    # H = log2(size) - S / size for S = sum of c log2 c, so H >= limit is S <= most
    most = (F.lit(math.log2(size)) - limit) * size
    stretch = lambda first, last: F.struct(first.alias("first"), last.alias("last"))

    def slide(c: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(1), F.lit(len(ALPHABET))), lambda k: F.size(F.filter(F.slice(c, 1, size), lambda x: x == k)))

        def run(first: Column, w: Column, top: Column, spans: Column) -> Column:
            weigh = lambda n: F.element_at(w, n + 1)
            none = F.lit(None).cast("int")
            start = F.struct(
                first.alias("n"),
                F.aggregate(first, F.lit(0.0), lambda s, n: s + weigh(n)).alias("s"),
                F.array().cast("array<struct<first:int,last:int>>").alias("done"),
                none.alias("first"),
                none.alias("last"),
            )

            def note(acc: Column, n: Column, s: Column, at: Column) -> Column:
                hot = (s <= top + 1e-9) & ~F.exists(spans, lambda b: (b["start"] < at + size) & (at < b["end"]))
                apart = hot & (at > acc["last"] + size)
                return F.struct(
                    n.alias("n"),
                    s.alias("s"),
                    F.when(apart, F.concat(acc["done"], F.array(stretch(acc["first"], acc["last"])))).otherwise(acc["done"]).alias("done"),
                    F.when(apart, at).otherwise(F.coalesce(acc["first"], F.when(hot, at))).alias("first"),
                    F.when(hot, at).otherwise(acc["last"]).alias("last"),
                )

            def step(acc: Column, at: Column) -> Column:
                gone, came = F.element_at(c, at), F.element_at(c, at + size)
                moved = F.transform(acc["n"], lambda n, i: n + F.when(i + 1 == came, 1).otherwise(0) - F.when(i + 1 == gone, 1).otherwise(0))
                a, b = F.element_at(acc["n"], gone), F.element_at(acc["n"], came)
                s = acc["s"] - weigh(a) + weigh(a - 1) - weigh(b) + weigh(b + 1)
                same = gone == came
                return note(acc, F.when(same, acc["n"]).otherwise(moved), F.when(same, acc["s"]).otherwise(s), at)

            begun = let(start, lambda acc: note(acc, acc["n"], acc["s"], F.lit(0)))
            steps = F.when(F.size(c) > size, F.sequence(F.lit(1), F.size(c) - size)).otherwise(F.array().cast("array<int>"))
            close = lambda acc: F.when(acc["first"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(stretch(acc["first"], acc["last"]))))
            return F.aggregate(steps, begun, step, close)

        return let(counts, lambda first: let(weights, lambda w: let(most, lambda top: let(taken, lambda spans: run(first, w, top, spans)))))

    return let(codes, slide)


def entropy_spans(text: Column, base: Column, size: int = SIZE, hex_bits: float = HEX_BITS, base64_bits: float = BASE64_BITS, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of high-entropy stretches in candidates that are not allow-listed, clear of base spans."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))

    def harmless(c: Column) -> Column:
        out = F.length(c) < size
        for pattern in allowed:
            out = out | c.rlike(pattern)
        return out

    def judge(c: Column, at: Column) -> Column:
        near = F.filter(base, lambda b: (b["start"] < at["end"]) & (at["start"] < b["end"]))
        taken = F.transform(near, lambda b: F.struct((b["start"] - at["start"]).alias("start"), (b["end"] - at["start"]).alias("end")))
        spans = F.transform(
            entropy_hits(c, taken, size, hex_bits, base64_bits),
            lambda h: F.struct((at["start"] + h["first"]).cast("long").alias("start"), F.lit(len(KINDS) - 1).alias("kind"), (at["start"] + h["last"] + size).cast("long").alias("end")),
        )
        return F.when(harmless(c), F.array().cast(f"array<{SPAN}>")).otherwise(spans)

    def pick(m: Column) -> Column:
        return F.flatten(F.zip_with(m, occurrences(text, CANDIDATE, len(KINDS) - 1), judge))

    return let(found, lambda m: F.when(F.size(m) > 0, pick(m)).otherwise(F.array().cast(f"array<{SPAN}>")))


def listing(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` plus ``base`` (fixed patterns) and ``spans`` (these and high entropy), by start and kind."""
    text = F.coalesce("text", F.lit(""))
    both = let(
        text,
        lambda t: let(
            base_spans(t), lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, entropy_spans(t, b))).alias("spans"))
        ),
    )
    inner, finish = carried(docs, "text")
    out = inner.withColumn("_found", both).withColumns({"base": F.col("_found")["base"], "spans": F.col("_found")["spans"]})
    return finish(out, "base", "spans")
