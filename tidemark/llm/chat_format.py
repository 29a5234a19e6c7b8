"""Chat formatting with a grammar round trip. DataFrame functions only.

A turn is rendered as ``### role:``, a new line, the text, a new line and
``</turn>`` with a new line. Control strings are three or more ``#`` and
``</turn>``. Every turn is rendered plain first and parsed again; where the parser
does not give back the source, the turn is rendered with one backslash before each
control string (and before the backslashes that stand there), which the parser
takes away again. The result is parsed once more as a whole and ``faithful`` says
whether it equals the source. Roles are percent-encoded where they hold a sign of
the grammar.

Defined cases: null text and null role are empty; rows of one conversation are
ordered by turn, then role, then text, nulls first; repeated rows are repeated
turns; a null conv_id is a conversation; a conversation of any length is one row and must
fit a task; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.llm.secret_scan import running_totals

CLOSE = "</turn>\n"
BORDER = r"(?<!\\)</turn>\n"
ROLE_SIGNS = (("%", "%25"), ("\n", "%0A"), ("#", "%23"), ("<", "%3C"), (":", "%3A"))
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)(\\*+)((?<!#)#{3,}|</turn>)", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)(#{3,}|</turn>)", "$1$2")


def encode_role(role: Column) -> Column:
    for sign, code in ROLE_SIGNS:
        role = F.replace(role, F.lit(sign), F.lit(code))
    return role


def decode_role(role: Column) -> Column:
    for sign, code in reversed(ROLE_SIGNS):
        role = F.replace(role, F.lit(code), F.lit(sign))
    return role


def head(role: Column) -> Column:
    return F.concat(F.lit("### "), encode_role(role), F.lit(":\n"))


def piece(role: Column, body: Column) -> Column:
    return F.concat(head(role), body, F.lit("\n"), F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted text; null where it breaks the grammar."""

    def turn(p: Column) -> Column:
        header = F.regexp_extract(p, r"^### ([^\n]*):\n", 0)
        body = F.substring(p, F.length(header) + 1, F.length(p) - F.length(header) - 1)
        sound = (F.length(header) > 0) & p.endswith(F.lit("\n")) & ~body.rlike(r"(?<![\\#])#{3,}|(?<!\\)</turn>")
        role = F.substring(header, F.lit(5), F.length(header) - 6)
        return F.when(sound, F.struct(decode_role(role).alias("role"), unescape(body).alias("text")))

    def turns(parts: Column) -> Column:
        found = F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)
        whole = (F.element_at(parts, -1) == "") & ~F.exists(found, lambda t: t.isNull())
        return F.when(whole, found)

    return let(F.split(formatted, BORDER, -1), turns)


def render(turn: Column) -> Column:
    """A turn as struct(text, body_start, body_length): plain where that survives the round trip, else escaped."""

    def choose(body: Column) -> Column:
        return F.struct(
            piece(turn["role"], body).alias("text"), F.length(head(turn["role"])).alias("skip"), F.length(body).alias("length"), turn["role"].alias("role")
        )

    plain = piece(turn["role"], turn["text"])
    same = F.coalesce(let(parse(plain), lambda t: t == F.array(turn)), F.lit(False))
    return let(F.when(same, turn["text"]).otherwise(escape(turn["text"])), choose)


def format_conversations(rows: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (spans (turn, start, length) of the learned texts, in code points), faithful."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    plain = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def build(pieces: Column) -> Column:
        text = F.array_join(F.transform(pieces, lambda p: p["text"]), "")
        ends = running_totals(F.transform(pieces, lambda p: F.length(p["text"])))
        placed = F.zip_with(pieces, ends, lambda p, e: F.struct(p["role"].alias("role"), (e - F.length(p["text"]) + p["skip"]).alias("start"), p["length"].cast("long").alias("length")))
        spans = F.transform(placed, lambda p, i: F.when(p["role"] == learn_from, F.struct(i.alias("turn"), p["start"].alias("start"), p["length"].alias("length"))))
        return F.struct(text.alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"))

    made = plain.withColumn("_made", let(F.transform("turns", render), build))
    return made.select(
        "conv_id", F.col("_made")["formatted"].alias("formatted"), F.col("_made")["loss"].alias("loss"),
        F.coalesce(let(parse(F.col("_made")["formatted"]), lambda t: t == F.col("turns")), F.lit(False)).alias("faithful"),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """What stands under the loss mask, unescaped and joined; every span is cut from its own turn, so time grows with the text."""

    def cut(parts: Column) -> Column:
        ends = running_totals(F.transform(parts, lambda p: F.length(p) + len(CLOSE)))
        begins = F.zip_with(parts, ends, lambda p, e: e - F.length(p) - len(CLOSE))

        def under(starts: Column) -> Column:
            at = lambda s: F.substring(F.element_at(parts, s["turn"] + 1), (s["start"] - F.element_at(starts, s["turn"] + 1) + 1).cast("int"), s["length"].cast("int"))
            return F.array_join(F.transform(loss, lambda s: unescape(at(s))), "")

        return let(begins, under)

    return let(F.split(formatted, BORDER, -1), cut)
