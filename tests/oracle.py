"""Run registered queries on both engines and compare; also usable as a script.

    python tests/oracle.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def kind(v) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return "bool"
    if isinstance(v, float) or "float" in type(v).__name__:
        return "float"
    if isinstance(v, int) or "int" in type(v).__name__:
        return "int"
    return type(v).__name__


def norm(v):
    k = kind(v)
    if k == "null" or v is pd.NaT or v is pd.NA:
        return None
    if k == "float":
        return round(float(v), 6) + 0.0
    if k == "bool":
        return bool(v)
    if k == "int":
        return int(v)
    if type(v).__name__ in ("list", "ndarray", "tuple"):
        return tuple(norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return ("decimal", str(v))
    return str(v)


def rows_of(cols, data) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf: str, fn, sql: str | None):
    """(ok, message): same columns, types, rows and values."""
    df = fn(spark, sf)
    got = df.collect()
    if len(set(df.columns)) != len(df.columns):
        return False, f"duplicate columns {df.columns}"
    if sql is None:
        return bool(got), f"{len(got)} rows, no SQL"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return False, f"rows {len(a)} != {len(b)}; first {a[:1]} | {b[:1]}"
    if not a:
        return False, "no rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y or [kind(v) for v in x] != [kind(v) for v in y]]
    if bad:
        return False, f"{len(bad)}/{len(a)} differ, cols {sorted(cols)}: {bad[0][0]} != {bad[0][1]}"
    return True, f"{len(a)} rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from riskspark.core.session import local_session

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    want = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, con, sf, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.2f}s {msg}", flush=True)
    print("failed:", bad)
