"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_s = time.time() - t
    if sql is None:
        return f"rows-only {len(got[1])}", spark_s, 0.0
    t = time.time()
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    duck_s = time.time() - t
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} vs {want[0]}", spark_s, duck_s
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        only_a, only_b = sorted(a - b)[:2], sorted(b - a)[:2]
        return f"DIFF {len(got[1])} vs {len(want[1])}\n   spark {str(only_a)[:700]}\n   duck  {str(only_b)[:700]}", spark_s, duck_s
    return f"ok {len(got[1])}", spark_s, duck_s


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from storyloom.session import build_session, release_scratch

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", shuffle_partitions=8)
    con = connect(sf_dir)
    oracles = E.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, query in E.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            result, a, b = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as error:  # show and go on
            result, a, b = f"ERROR {str(error)[:900]}", 0, 0
        release_scratch(spark)
        bad += not result.startswith(("ok", "rows-only"))
        print(f"{name:34s} {a:6.2f}s {b:6.2f}s {result}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
