"""Run registered queries and their SQL side by side."""

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder, name, fn, sql):
    """Returns (problem or None, rows, seconds Spark, seconds SQL)."""
    t0 = time.time()
    df = fn(spark, folder)
    mine = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return None, len(mine), t1 - t0, 0.0
    cur = duck(folder).execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}", len(mine), t1 - t0, t2 - t1
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}", len(mine), t1 - t0, t2 - t1
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}", len(mine), t1 - t0, t2 - t1
    return None, len(mine), t1 - t0, t2 - t1


if __name__ == "__main__":
    import os
    import sys
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from itemweld.session import local_session
    spark = local_session(8)
    folder = sys.argv[1]
    only = sys.argv[2:]
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        try:
            problem, n, s, d = compare(spark, folder, name, fn, sqls.get(name))
        except Exception as e:
            problem, n, s, d = f"{type(e).__name__}: {str(e)[:600]}", -1, 0, 0
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} spark={s:.1f}s sql={d:.1f}s "
              f"{'' if name in sqls else '[rows only] '}{problem or ''}", flush=True)
    print("failures", bad)
