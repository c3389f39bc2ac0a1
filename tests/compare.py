"""Run registered queries next to their SQL text and compare all rows.

    python tests/compare.py [--dir FOLDER] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def sql_rows(con, text):
    rel = con.sql(text)
    return list(rel.columns), rel.fetchall()


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, normal(v)) for k, v in value.items())
    if isinstance(value, int):
        return value
    if hasattr(value, "asDict"):
        return tuple(normal(v) for v in value)
    return str(value)


def rows_as_sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def close_enough(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None or isinstance(a, str) or isinstance(b, str):
            return a == b
        return abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b)) * 1.01
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close_enough(x, y) for x, y in zip(a, b))
    return a == b


def compare(spark, con, query, text, folder):
    df = query(spark, folder)
    got_cols, got = rows_as_sorted(df.columns, [tuple(r) for r in df.collect()])
    if text is None:
        return True, f"{len(got)} rows, no SQL"
    cols, rows = sql_rows(con, text)
    want_cols, want = rows_as_sorted(cols, rows)
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; first got {got[:1]} want {want[:1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        far = [(g, w) for g, w in bad if not close_enough(g, w)]
        if far:
            return False, f"{len(far)} rows differ ({len(bad)} inexact), e.g.\n   got  {far[0][0]}\n   want {far[0][1]}"
        return True, f"{len(got)} rows, {len(bad)} inexact: {bad[0]}"
    return True, f"{len(got)} rows"


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry_module
    from barloom.session import build_session

    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.dir)
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    failed = []
    for name in args.names or queries:
        started = time.time()
        try:
            ok, note = compare(spark, con, queries[name], sql.get(name), args.dir)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
