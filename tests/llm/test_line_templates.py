"""Recurring line templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import line_templates, shared

NOTICE = "this work is shared under the terms of version {} of the licence"


def cleaned(docs, **kw):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_templates.drop_recurring(docs, **kw).collect()}


def test_digits_and_general_leaves(spark):
    rows = [
        (1, f"first document has its own line here today\n{NOTICE.format(1)}\nshort"),
        (2, f"{NOTICE.format(22)}\nsecond document has another own line here now\nshort"),
        (3, "user logged in from host alpha at the north gate\nkept"),
        (4, "user logged in from host omega at the north gate\nkept"),
        (5, "one two three four differs wholly from that next one yes"),
        (6, "one two three alpha beta gamma delta eps zeta eta theta"),
    ]
    got = cleaned(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[1] == (rows[0][1], 3, 0)
    assert got[2] == ("second document has another own line here now\nshort", 3, 1)
    assert got[3][0] == rows[2][1] and got[4] == ("kept", 2, 1)  # same leaf, one field differs
    assert got[5][2] == got[6][2] == 0  # same leaf, too different


def test_a_template_beside_other_lines_of_its_leaf(spark):
    """A line with the same count and lead, alone or with many more, hides no template."""
    names = ["alpha", "omega", "gamma", "delta"]
    rows = [(k, f"user logged in from host {name} at the north gate") for k, name in enumerate(names)]
    rows += [(10 + k, f"user logged in by mistake while {name} slept very well") for k, name in enumerate(names[:2])]
    odd = [(100, "user logged in one two three four five six seven")]
    more = odd + [(101 + k, "user logged in " + " ".join(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[(k + j) % 10]}{'uvwxyz'[j % 6]}" for j in range(7))) for k in range(9)]
    for extra in (odd, more):
        got = cleaned(spark.createDataFrame(rows + extra, "doc_id long, text string"))
        assert {k for k, v in got.items() if v[2]} == {1, 2, 3, 11}
        assert got[0][0] == rows[0][1] and got[1][0] == ""


def test_columns_nulls_repeats_and_long_documents(spark):
    line = "a line of at least eight tokens that returns"
    rows = [(1, line), (1, line), (None, line), (2, None), (3, ""), (4, "\n"), (5, "\n".join([line] * 5000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("x"), "key": F.lit(1), "_gone": F.lit(2)})
    out = line_templates.drop_recurring(docs)
    assert out.columns == ["doc_id", "text", "key", "_gone", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str)
    # the null id comes first, so the others lose the line
    assert got == sorted([(1, "", 1, 1), (1, "", 1, 1), (None, line, 1, 0), (2, None, 0, 0), (3, "", 1, 0), (4, "\n", 2, 0), (5, "", 5000, 5000)], key=str)
    assert line_templates.drop_recurring(docs.limit(0)).count() == 0


def test_shorter_lines_need_more_documents(spark):
    many = "All rights reserved.\n\nPart 1{0} of 9\n4{0}\n77\nI went to {1}"
    rows = [(k, many.format(k, "abcdefghijklmnop"[k])) for k in range(10)] + [(20 + k, "In three documents only") for k in range(3)] + [(30 + k, "yes") for k in range(15)]
    rows += [(50 + k, "no") for k in range(16)]
    got = cleaned(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[0] == (rows[0][1], 6, 0)
    # numbers alone are compared as they are and 77 needs 16 documents; a line just longer than its lead has no field there
    assert all(got[k] == (f"\n4{k}\n77\nI went to {'abcdefghijklmnop'[k]}", 6, 2) for k in range(1, 10))
    assert all(got[20 + k][2] == 0 for k in range(3)) and all(got[30 + k][2] == 0 for k in range(15))
    assert [got[50 + k][2] for k in range(16)] == [0] + [1] * 15


def test_many_lines_of_one_leaf_take_few_rounds(spark):
    lines = [f"user logged in from host {a} at the {b} gate" for a in ("x", "y", "z", "u") for b in ("north", "south", "east")]
    lines += ["user logged in " + " ".join(f"{c}{'klmnopqrst'[j]}{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghij'[i // 26]}" for j, c in enumerate("qwertyu")) for i in range(48)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string")
    got = cleaned(docs)
    assert sorted(k for k, v in got.items() if v[2]) == list(range(1, 12))


def test_min_docs(spark):
    docs = spark.createDataFrame([(k, "a line of at least eight tokens that returns") for k in range(4)], "doc_id long, text string")
    assert [v[2] for _, v in sorted(cleaned(docs, min_docs=5).items())] == [0, 0, 0, 0]
    assert [v[2] for _, v in sorted(cleaned(docs, min_docs=4).items())] == [0, 1, 1, 1]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_templates.drop_recurring(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_stored_lines_end_once_templates_are_known(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"{NOTICE.format(k)}\nown{k} words of document {k} only") for k in range(5)], "doc_id long, text string")
    monkeypatch.setattr(shared, "shared_folder", lambda _: str(tmp_path))
    out = line_templates.drop_recurring(docs)
    assert [spark.read.parquet(str(f)).count() for f in tmp_path.glob("lines-*")] == [0]
    assert sorted(r.n_dropped for r in out.collect()) == [0, 2, 2, 2, 2]


def test_shuffles_of_stored_tables_end_with_the_write(spark, monkeypatch):
    seen, write = [], type(spark.range(1).write).parquet

    def watched(writer, *args, **options):
        seen.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None))
        return write(writer, *args, **options)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", watched)
    assert shared.stored(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "t").count() == 3
    assert seen == ["true"] and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_working_tables_are_given_back(spark, monkeypatch):
    files = {}

    def noted(df, name, *args):
        out = shared.stored(df, name, *args)
        files.setdefault(name, []).append((out.schema, out.inputFiles()))
        return out

    monkeypatch.setattr(line_templates, "stored", noted)
    docs = spark.createDataFrame([(k, f"user {k} logs in from here\nat {k} o'clock a user {'xyz'[k % 3]} leaves") for k in range(12)], "doc_id long, text string")
    assert sum(r.n_dropped for r in line_templates.drop_recurring(docs).collect()) > 0
    assert len(files["cells"]) == line_templates.ROUNDS + 1 and files["cells"][0][1]
    for schema, written in files["cells"] + files["frequent"]:
        assert not written or spark.read.schema(schema).parquet(written[0].rsplit("/", 1)[0]).count() == 0
    assert all(f.endswith(".zstd.parquet") for _, written in files["lines"] for f in written)
