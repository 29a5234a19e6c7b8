"""Compare registered queries with their SQL in DuckDB.

    python tools/check_oracle.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if v != v else repr(v + 0.0)
        return str(v)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    began = time.time()
    df = fn(spark, sf_dir)
    got_rows = [tuple(x) for x in df.collect()]
    took = time.time() - began
    if sql is None:
        return True, f"rows={len(got_rows)} {took:.1f}s (no SQL)"
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return False, f"columns {sorted(df.columns)} != {sorted(want_names)}"
    got, want = canonical(df.columns, got_rows), canonical(want_names, want_rows)
    if got == want:
        return True, f"rows={len(got)} {took:.1f}s"
    only_got = [x for x in got if x not in set(want)][:3]
    only_want = [x for x in want if x not in set(got)][:3]
    return False, f"rows {len(got)} vs {len(want)}; only spark {only_got}; only sql {only_want}"


def main() -> int:
    from tidemark.plans.catalog import ORACLES, QUERIES
    from tidemark.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            ok, note = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as e:  # report and go on with the other queries
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
