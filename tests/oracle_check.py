"""Run registered queries next to their DuckDB counterparts and compare whole results.

    python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else a message."""
    s_names, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    d_names, d_rows = rows_of([c[0] for c in cur.description], cur.fetchall())
    if s_names != d_names:
        return f"columns {s_names} != {d_names}", 0
    if s_rows != d_rows:
        a, b = set(s_rows) - set(d_rows), set(d_rows) - set(s_rows)
        return (
            f"{len(s_rows)} spark rows, {len(d_rows)} duckdb rows; "
            f"only spark {len(a)} {sorted(a)[:3]}; only duckdb {len(b)} {sorted(b)[:3]}"
        ), len(s_rows)
    return None, len(s_rows)


def main():
    import __spark_entry__ as e
    from splitsight.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in e.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            sql = e.oracle_sql().get(name)
            if sql is None:
                msg, n = None, df.count()
                print(f"rows  {name} {n} rows {time.time()-t0:.1f}s", flush=True)
                continue
            msg, n = compare(df, con, sql)
        except Exception as ex:  # noqa: BLE001
            msg, n = f"{type(ex).__name__}: {str(ex)[:900]}", 0
        bad += msg is not None
        print(f"{'ok   ' if msg is None else 'BAD  '}{name} {n} rows {time.time()-t0:.1f}s"
              + (f"\n      {msg}" if msg else ""), flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
