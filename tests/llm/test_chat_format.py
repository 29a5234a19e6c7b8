"""Round trips of conversations that hold the template's own signs."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tidemark.llm import chat_format, queries

HARD = [
    "", "plain", "###", "####", r"\###", r"\\####", "</turn>", r"\</turn>", "a\n</turn>\n### user:\nb", "### assistant:\n", "\\", "\\\\", "ends \\\n", "\n", "é 🎉 ###x</turn>",
    "</turn>\n", "##", "# # #", r"\### Assistant: </turn> ok", "#" * 50 + "\\" * 50 + "###", "x" * 100_000,
]


def read_back(df):
    return df.select(
        "conv_id", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("learned"), "formatted", "loss", "faithful"
    )


def test_round_trip(spark):
    roles = ["user", "assistant", "system", "a:b", "x\ny", "50%", "%0A", "###", "</turn>", ""]
    rows = [(1, k, roles[k % len(roles)], t) for k, t in enumerate(HARD * 3)]
    got = read_back(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [(t.role, t.text) for t in got.turns] == [(r, t) for _, _, r, t in rows]
    assert got.learned == "".join(t for _, _, r, t in rows if r == "assistant") and got.faithful
    cut = "".join(got.formatted[s.start : s.start + s.length] for s in got.loss)
    assert len(got.loss) == sum(r == "assistant" for _, _, r, _ in rows) and "### user" not in cut


def test_every_short_mix_of_signs_survives(spark):
    parts = ["#", "###", "\\", "</turn>", "\n", "x"]
    texts = ["".join(p) for n in range(6) for p in itertools.product(parts, repeat=n)]
    rows = [(k // 40, k, "assistant", t) for k, t in enumerate(texts)]
    out = read_back(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in out.collect():
        own = texts[40 * r.conv_id : 40 * (r.conv_id + 1)]
        assert r.faithful and [t.text for t in r.turns] == own and r.learned == "".join(own)


def test_plain_texts_stay_plain(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a # b")]
    got = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got.formatted == "### user:\nhi\n</turn>\n### assistant:\na # b\n</turn>\n"


def test_nulls_ties_and_empty(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "b"), (1, None, None, None), (None, 0, "assistant", "x"), (1, 1, "assistant", None)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "turns": F.lit(2)})
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.learned) for r in read_back(chat_format.format_conversations(docs)).collect()}
    assert got == {1: ([("", ""), ("assistant", ""), ("user", "b"), ("user", "b")], ""), None: ([("assistant", "x")], "x")}
    assert chat_format.format_conversations(docs.limit(0)).count() == 0


def test_broken_text_is_null(spark):
    df = spark.createDataFrame([("no turn",), ("### user:\na\n",), ("### user:\n### x\n</turn>\n",), ("",)], "t string")
    assert [r[0] for r in df.select(chat_format.parse(F.col("t"))).collect()] == [None, None, None, []]


def test_the_query_tells_whether_each_round_trip_is_whole(spark, tmp_path, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "#</turn>\nb"), (2, 0, "user", r"\###"), (2, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    kept = lambda: {r.conv_id: r.faithful for r in queries.op7(spark, str(tmp_path)).collect()}
    assert kept() == {1: True, 2: True, -7: True}
    monkeypatch.setattr(chat_format, "escape", lambda text: text)
    assert kept() == {1: False, 2: False, -7: False}
