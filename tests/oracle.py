"""Compare registered queries with their SQL: rows, column names, types and values in any order.

Run as ``python tests/oracle.py [folder] [query …]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else repr(v)) for v in row)


def _clean(v):
    return 0.0 if isinstance(v, float) and v == 0 and not math.copysign(1, v) > 0 else v


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    rows = cur.fetchall()
    order = sorted(names)
    if sorted(df.columns) != order:
        return f"columns {sorted(df.columns)} != {order}"
    wrong = {c: (t, types[c]) for c, t in df.dtypes if TYPES.get(t, t) != types[c]}
    if wrong:
        return f"types {wrong}"
    got = sorted((tuple(r) for r in df.select(*order).collect()), key=_key)
    at = [names.index(c) for c in order]
    want = sorted((tuple(r[i] for i in at) for r in rows), key=_key)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    return None


def main() -> int:
    import __spark_entry__ as e
    from tests.session import session

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf)
    queries, sqls = e.queries(), e.oracle_sql()
    failed = 0
    for name in args[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                kind = "sql "
            else:
                problem, kind = (None if df.count() else "no rows"), "rows"
        except Exception as err:  # noqa: BLE001 - report and go on
            problem, kind = f"{type(err).__name__}: {str(err)[:600]}", "?   "
        failed += problem is not None
        print(f"{kind} {'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
