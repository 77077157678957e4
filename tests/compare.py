"""Run registered queries and their SQL checks side by side.

    python tests/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def differences(spark, name, fn, sql, sf_dir):
    """A list of complaints; empty when the two agree exactly."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return [], len(got), took, 0.0
    con = duck(sf_dir)
    start = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - start
    said = []
    if sorted(df.columns) != sorted(want_cols):
        return [f"columns {sorted(df.columns)} != {sorted(want_cols)}"], len(got), took, sql_took
    if len(got) != len(want):
        said.append(f"rows {len(got)} != {len(want)}")
    kinds = dict(df.dtypes)
    for d in cur.description:
        k, w = kinds[d[0]], str(d[1])
        pair = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                "int": "INTEGER"}.get(k, k)
        if pair != w:
            said.append(f"type of {d[0]}: {k} vs {w}")
    a, b = rows(got, df.columns), rows(want, want_cols)
    if a != b:
        names = sorted(df.columns)
        sa, sb = set(a), set(b)
        only_a = [x for x in a if x not in sb][:3]
        only_b = [x for x in b if x not in sa][:3]
        said.append(f"values differ {len(sa - sb)}/{len(sb - sa)} {names}\n   spark {only_a}\n   sql   {only_b}")
    return said, len(got), took, sql_took


def main():
    from tests.conftest import make_session
    import __spark_entry__ as e
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = make_session()
    sqls = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            said, n, took, sql_took = differences(spark, name, fn, sqls.get(name), sf_dir)
        except Exception as err:  # report and go on
            said, n, took, sql_took = [f"{type(err).__name__}: {str(err)[:1500]}"], 0, 0, 0
        state = "ok  " if not said else "FAIL"
        state = state if sqls.get(name) or said else "rows"
        bad += bool(said)
        print(f"{state} {name:28s} {n:7d} rows  {took:6.2f}s  sql {sql_took:6.2f}s", flush=True)
        for s in said:
            print("    ", s, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
