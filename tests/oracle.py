"""Compare registered queries with their SQL in DuckDB.

    python -m tests.oracle [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

from catalog import ORACLES, QUERIES
from handful.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return f"{type(value).__name__}:{value}"


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, type(v).__name__, v if v is not None else 0) for v in r))


def difference(spark, con, name: str, sf: str) -> str:
    """'' when the query equals its SQL, else what differs."""
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = [tuple(_plain(v) for v in row) for row in df.select(*names).collect()]
    if name not in ORACLES:
        return "" if got else "no rows"
    result = con.execute(ORACLES[name])
    theirs = [d[0] for d in result.description]
    if sorted(theirs) != names:
        return f"columns {names} against {sorted(theirs)}"
    order = [theirs.index(c) for c in names]
    want = [tuple(_plain(row[i]) for i in order) for row in result.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    if not got:
        return "no rows on both sides"
    for a, b in zip(_sorted(got), _sorted(want)):
        if a != b:
            return f"columns {names}: {a!s:.600} against {b!s:.600}"
    return ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = build_session(os.environ.get("ORACLE_MASTER", "local[8]"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    wanted = [n for n in QUERIES if not args.names or any(n.startswith(a) for a in args.names)]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = difference(spark, con, name, args.sf)
        except Exception as exc:  # noqa: BLE001 - report every query
            problem = f"{type(exc).__name__}: {exc!s:.900}"
            con = connect(args.sf)
        bad += bool(problem)
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} good")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
