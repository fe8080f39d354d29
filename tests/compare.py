"""Compare queries with their SQL, as `python tests/compare.py <folder> [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return db


def _rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda row: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)
    return sorted((tuple(row[i] for i in at) for row in rows), key=key)


def difference(spark, db, folder: str, query, sql: str) -> str | None:
    """None if the rows are the same; else what differs first."""
    df = query(spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            if x != y or type(x) is not type(y) or (isinstance(x, float) and math.isnan(x)):
                return f"{a} against {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry_points
    from topicspark.session import build_session

    session = build_session("compare", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    where, chosen = sys.argv[1], sys.argv[2:]
    sql = entry_points.oracle_sql()
    data = database(where)
    bad = 0
    for name, fn in entry_points.queries().items():
        if chosen and name not in chosen:
            continue
        began = time.time()
        try:
            found = difference(session, data, where, fn, sql[name])
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{name}: {'ok' if found is None else found} {time.time() - began:.1f}s", flush=True)
    print("different:", bad)
    sys.exit(bad > 0)
