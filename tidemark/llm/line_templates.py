"""Line dedup by a log-template tree. DataFrame functions only.

A line's path in the tree is fixed: its token count, then its leading tokens, with
tokens that hold a digit read as a variable field (a line of nothing else is taken as it
is). A group of lines whose tokens behind the leading ones agree in most positions is one
template with variable fields where they differ. Any other group is parted by signature: a
line keeps its frequent tokens, those that enough lines of the group hold at their
position, and lines with equal frequent tokens go on together. The tree is ROUNDS parts deep;
lines of groups that do not agree by then are a template each, as they are. So one
template is found beside any other lines of its leaf.

A template found in several documents is recurring: its lines stay in the first of these
documents and are dropped from the others, so nothing is lost from the corpus. Short
templates need more documents, EVIDENCE tokens in all; one rule holds for every length.

Rows that travel hold hashes and positions; only distinct lines of leaves with differing
lines are sent as tokens. Templates are counted after a distinct by document, so a
line that a third of all documents share is pre-aggregated and never gathered; what holds
many rows of a join is few and broadcast (``shared.join_classes``).

Defined cases: null text stays null, empty text stays empty; blank lines
always stay; rows equal in doc_id and text are one document, of equal ones the first has the smallest doc_id, null before all;
documents are never dropped, a document may become empty; a text or line of any length is read
whole, in one task; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.llm.shared import broadcast_if_small, carried, emptied, join_classes, stored, text_key, upto

MIN_DOCS = 2
EVIDENCE = 16
"""A recurring template of n tokens stands in at least EVIDENCE / n documents."""
LEADING = 3
AGREEMENT = 0.7
ROUNDS = 2
FREQUENT, LEAST_LINES = 8, 2
"""A token is frequent when at least LEAST_LINES lines and one in FREQUENT of the group hold it at its position."""
FIELD = "<*>"
LEAF_BYTES = 64
"""Generous size of one broadcast leaf."""
NUMBERS = "^(?:[^ 0-9]*+[0-9][^ ]*+(?: |$))+$"


def pair(*parts) -> Column:
    """128 bits of hash."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(LEADING), *parts).alias("b"))


def tokenized_lines(docs: DataFrame, leading: int = LEADING) -> DataFrame:
    """doc_id, key, pos, masked, n, and hashes of the leaf and of the masked line (line) of every line that is not blank."""

    def mask(line):
        spaced = reduce(or_, [F.contains(line, F.lit(x)) for x in ("\t", "\r", "\f", "  ")])
        plain = F.trim(F.when(spaced, F.regexp_replace(line, "[ \t\r\f]+", " ")).otherwise(line))
        return let(plain, lambda x: F.when(x.rlike("[0-9]") & ~x.rlike(NUMBERS), F.regexp_replace(x, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(x))

    # masked inside the array: each line once, however often it is used below
    masked = F.transform(F.split("text", "\n", -1), mask)
    rows = docs.select("doc_id", text_key("text").alias("key"), F.posexplode(masked).alias("pos", "masked")).where("masked <> ''")
    rows = rows.withColumn("n", F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1)
    return rows.withColumns({"leaf": pair("n", F.substring_index("masked", " ", leading)), "line": pair("masked")})


def judged(open_: DataFrame, leading: int, total: int) -> DataFrame:
    """The lines (line, group, tokens) that share their group with others, with the positions that agree in it and their frequent tokens as one hash; stored.

    Every line of a group holds its first token, so the largest count of a group is its size. ``total`` bounds the tokens.
    """
    tokens = open_.select("line", "group", F.posexplode("tokens").alias("at", "token")).select("line", "group", "at", pair("group", "at", "token").alias("cell"))
    cells = stored(tokens.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_LINES), "cells")
    sizes = cells.groupBy("group").agg(F.max("n").alias("lines"))
    often = cells.join(sizes, "group").where(F.col("n") * FREQUENT >= F.col("lines"))
    kept = stored(often.select("cell", "n", (F.col("n") == F.col("lines")).alias("same")), "frequent")
    emptied(cells)
    met = join_classes(tokens.select("line", "at", "cell"), kept, "cell", "line", total).where("same IS NOT NULL")
    per = met.groupBy("line").agg(
        F.sum((F.col("same") & (F.col("at") >= leading)).cast("int")).alias("agree"),
        F.struct(F.bit_xor(F.xxhash64("at", "cell")).alias("a"), F.bit_xor(F.xxhash64("cell", "at")).alias("b")).alias("signature"),
    )
    out = stored(open_.join(per, "line"), "judged")
    emptied(kept)
    return out


def grouped_lines(slim: DataFrame, lines: DataFrame, leading: int = LEADING, agreement: float = AGREEMENT, rounds: int = ROUNDS) -> DataFrame:
    """line, group: the template of every distinct line of a leaf with differing lines that shares one."""
    varied = slim.groupBy("leaf").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi")
    varied = stored(varied.select("leaf"), "varied")
    # few leaves: lines are filtered where they are, else they meet by a shuffle
    own = lines.join(broadcast_if_small(varied, varied.count(), LEAF_BYTES), "leaf")
    open_ = own.groupBy("line").agg(F.first("leaf").alias("group"), F.split(F.first("masked"), " ").alias("tokens"))
    open_ = stored(open_, "mixed")
    total = open_.agg(F.sum(F.size("tokens"))).first()[0] or 0
    settled = []
    for r in range(rounds + 1):
        met = judged(open_, leading, total)
        # the leading tokens agree by construction
        behind = F.size("tokens") - leading
        whole = F.col("agree") / behind >= agreement
        settled.append(met.where((behind > 0) & whole).select("line", "group"))
        if r < rounds:
            open_ = met.where((behind > 0) & ~whole).select("line", pair("group", "signature").alias("group"), "tokens")
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def recurring_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, agreement: float = AGREEMENT, rounds: int = ROUNDS, evidence: int = EVIDENCE
) -> DataFrame:
    """doc_id, key, dropped: positions of the lines whose template an earlier document has, for recurring templates."""
    # held through all rounds, and nearly as large as the texts
    lines = stored(tokenized_lines(docs, leading), "lines", "zstd")
    slim = lines.select("doc_id", "key", "pos", "n", "leaf", "line")
    groups = grouped_lines(slim, lines, leading, agreement, rounds)
    held = stored(groups.join(slim.groupBy("line").agg(F.count(F.lit(1)).alias("n")), "line"), "held")
    placed = join_classes(slim.withColumnRenamed("n", "tokens"), held, "line", "pos")
    placed = stored(placed.select("doc_id", "key", "pos", "tokens", F.coalesce("group", "line").alias("template")), "templates")
    emptied(lines)
    spread = placed.groupBy("template", "doc_id", "key").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    needed = F.greatest(F.lit(min_docs), F.ceil(F.lit(evidence) / F.col("tokens")))
    recurring = (
        spread.groupBy("template")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "key")).alias("first"), F.first("tokens").alias("tokens"), F.sum("rows").alias("n"))
        .where(F.col("n_docs") >= needed)
        .select("template", "n", "first")
    )
    met = join_classes(placed, stored(recurring, "recurring"), "template", "pos").where("first IS NOT NULL")
    first = F.col("first")
    later = met.where(~(F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("key") == first["key"])))
    return later.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("dropped"))


def drop_recurring(
    docs: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, agreement: float = AGREEMENT, rounds: int = ROUNDS, evidence: int = EVIDENCE
) -> DataFrame:
    """All columns of ``docs`` with recurring lines taken out of ``text``, plus n_lines and n_dropped."""
    gone = recurring_lines(docs, min_docs, leading, agreement, rounds, evidence).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("dropped").alias("_gone")
    )
    inner, finish = carried(docs, "doc_id", "text")
    rows = inner.withColumn("_h", text_key("text"))
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["_h"] == gone["_key"]), "left")

    def cut(parts):
        left = F.array_except(upto(F.size(parts)), F.col("_gone"))
        return F.array_join(F.transform(left, lambda i: F.element_at(parts, i + 1)), "\n")

    text = F.when(F.col("_gone").isNull(), rows["text"]).otherwise(let(F.split("text", "\n", -1), cut))
    count = F.when(rows["text"].isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    # a left join leaves _gone null where nothing is dropped; size() of null would be -1
    out = joined.withColumns(
        {
            "n_lines": count.cast("long"),
            "n_dropped": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"),
            "text": text,
        }
    )
    return finish(out, "n_lines", "n_dropped")
