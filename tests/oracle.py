"""Run registered queries against their SQL twins and compare rows exactly."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (value if value else 0.0)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise a short account of the difference."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    rows = rel.fetchall()
    ours = [tuple(row) for row in spark_df.collect()]
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    order, other = sorted(spark_df.columns), {n: i for i, n in enumerate(names)}
    mine = {n: i for i, n in enumerate(spark_df.columns)}
    left = Counter(tuple(_plain(r[mine[c]]) for c in order) for r in ours)
    right = Counter(tuple(_plain(r[other[c]]) for c in order) for r in rows)
    if left == right:
        types = [set(map(type, col)) for col in zip(*left)] if left else []
        types2 = [set(map(type, col)) for col in zip(*right)] if right else []
        return None if types == types2 else f"types {list(zip(order, types, types2))}"
    only = [list((left - right).items())[:2], list((right - left).items())[:2]]
    return f"rows {len(ours)} vs {len(rows)}; {order}; only ours {only[0]}; only SQL {only[1]}"


def main(folder: str, *wanted: str) -> int:
    from tallyscope.plans import registry
    from tallyscope.session import build_session

    spark = build_session(master="local[8]", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=8, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    oracle = registry.oracle_sql()
    for name, query in registry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            verdict = compare(df, con, oracle[name]) if name in oracle else f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        if verdict and not verdict.startswith("rows only"):
            bad += 1
        print(f"{name:45s} {time.time() - start:6.2f}s  {verdict or 'ok'}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
