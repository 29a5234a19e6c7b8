"""The queries of the llm subpackage: registered, named, and equal to their SQL where there is one."""

from __future__ import annotations

import pytest
from check_oracle import compare, connect

from tidemark.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    ok, note = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert ok, note


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == []
    assert "pipeline" in names
