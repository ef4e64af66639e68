"""Run registered queries next to their SQL: ``python tests/oracle.py <sf> [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return str(value) if value is not None and not isinstance(value, (int, str, bool)) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name, run, sql, sf_dir):
    start = time.time()
    df = run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return len(got), None, "rows only", took
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got), len(want), f"columns {sorted(df.columns)} != {sorted(names)}", took
    if got == want:
        return len(got), len(want), "ok", took
    extra = [r for r in got if r not in set(want)][:2]
    missing = [r for r in want if r not in set(got)][:2]
    return len(got), len(want), f"DIFFERENT spark-only {extra} sql-only {missing}", took


def main():
    import __spark_entry__ as entry
    from tracewright.session import spark_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:]
    spark = spark_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            n_got, n_want, state, took = compare(spark, con, name, run, oracle.get(name), sf_dir)
        except Exception as problem:
            n_got = n_want = None
            state, took = f"ERROR {type(problem).__name__}: {str(problem)[:600]}", 0.0
        bad += state not in ("ok", "rows only") or not n_got
        print(f"{name:32} {n_got} {n_want} {took:6.2f}s {state}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
