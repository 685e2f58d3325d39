"""Run registered queries and compare them with their oracle SQL: python tools/compare.py SF_DIR [name ...]."""
from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from rebuyflow.catalog import all_oracles, all_queries  # noqa: E402
from rebuyflow.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, int) and not isinstance(value, bool):
        return int(value)
    return value


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(con, spark, name, sf_dir):
    """(rows, problem or None, seconds) of one query."""
    started = time.time()
    df = all_queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    sql = all_oracles().get(name)
    if sql is None:
        return len(rows), None, seconds
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return len(rows), f"columns {sorted(df.columns)} vs {sorted(columns)}", seconds
    if len(rows) != len(expected):
        return len(rows), f"rows {len(rows)} vs {len(expected)}", seconds
    a, b = multiset(df.columns, rows), multiset(columns, expected)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    return len(rows), f"{len(different)} differ, first {different[0]} ({sorted(columns)})" if different else None, seconds


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(all_queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    failed = 0
    for name in names:
        try:
            n, problem, seconds = compare(con, spark, name, sf_dir)
        except Exception as error:  # report and go on to the next query
            n, problem, seconds = 0, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {n:8d} rows {seconds:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    sys.exit(failed > 0)


if __name__ == "__main__":
    main()
