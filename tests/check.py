"""Compare registered queries with their SQL in DuckDB.

usage: python tests/check.py [sf_dir] [name-prefix ...]
"""
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir, name, function, sql):
    started = time.time()
    frame = function(spark, sf_dir)
    columns = sorted(frame.columns)
    rows = [tuple(r) for r in frame.select(*columns).collect()]
    took = time.time() - started
    if sql is None:
        return f"rows {len(rows)}", took, rows[:2]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    found = cursor.fetchall()
    if sorted(names) != columns:
        return f"COLUMNS {columns} vs {sorted(names)}", took, []
    order = [names.index(c) for c in columns]
    left = sorted(tuple(map(canon, r)) for r in rows)
    right = sorted(tuple(canon(r[i]) for i in order) for r in found)
    if left == right:
        return f"ok {len(left)}", took, []
    only_l, only_r = sorted(set(left) - set(right))[:3], sorted(set(right) - set(left))[:3]
    return f"DIFF {len(left)} vs {len(right)}", took, [columns, only_l, only_r]


if __name__ == "__main__":
    from packetloom.session import build_session
    from __spark_entry__ import oracle_sql, queries
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, wanted, bad = oracle_sql(), sys.argv[2:], 0
    for name, function in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            outcome, took, detail = compare(spark, con, sf_dir, name, function, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            outcome, took, detail = f"ERROR {type(error).__name__}: {str(error)[:400]}", 0.0, []
        bad += not outcome.startswith(("ok", "rows"))
        print(f"{name:24s} {took:6.2f}s {outcome}", flush=True)
        if not outcome.startswith("ok"):
            for part in detail:
                print("      ", str(part)[:600])
    print("bad:", bad)
