"""Runs a registered query and its SQL on the same files and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("float", round(v, 6))
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, datetime.datetime):
        return ("ts", v.replace(tzinfo=None).isoformat())
    return (type(v).__name__, v) if not isinstance(v, (list, dict, bytearray, bytes)) else (type(v).__name__, repr(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canon(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> tuple[bool, str]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        return False, (f"rows {sum(got.values())} / {sum(want.values())}; only spark {list((got - want).items())[:2]}; "
                       f"only sql {list((want - got).items())[:2]}")
    return True, f"{sum(got.values())} rows"


def main(argv):
    from changeflow.session import local_session
    from __spark_entry__ import oracle_sql, queries
    sf = argv[0] if argv else "0.01"
    only = argv[1:]
    spark, con = local_session(8), connect(f"/root/testdata/sf{sf}")
    oracles, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            df = fn(spark, f"/root/testdata/sf{sf}")
            if name in oracles:
                ok, note = compare(df, con, oracles[name])
            else:
                ok, note = True, f"{df.count()} rows (no SQL)"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t:6.2f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(1 if main(sys.argv[1:]) else 0)
