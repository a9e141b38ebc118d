"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "None" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, int):
        return f"{v:.6g}" if abs(v) < 10**6 else str(v)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


def differences(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    other = rows([c[0] for c in cur.description], cur.fetchall())
    if mine[0] != other[0]:
        return len(mine[1]), [("columns", mine[0], other[0])]
    a, b = Counter(mine[1]), Counter(other[1])
    diff = [("spark", n, r) for r, n in (a - b).items()] + [("sql", n, r) for r, n in (b - a).items()]
    return len(mine[1]), diff[:6]


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from catamatch.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    for name, sql in entry.oracle_sql().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            n, diff = differences(spark, con, entry.queries()[name], sql, sf_dir)
        except Exception as e:  # noqa: BLE001
            n, diff = -1, [str(e)[:700]]
        print(f"{'ok  ' if not diff else 'DIFF'} {name} rows={n} {time.time() - t0:.1f}s", flush=True)
        for d in diff:
            print("     ", d)
