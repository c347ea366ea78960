"""Run registered queries in Spark and their SQL in DuckDB on the same tables, and compare.

usage: python tests/compare.py [sf] [prefix ...]
"""

import datetime
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(df, con, sql):
    got_cols = df.columns
    got = rows_of(got_cols, df.collect())
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}", len(got)
    if got != want:
        a, b = set(map(repr, got)) - set(map(repr, want)), set(map(repr, want)) - set(map(repr, got))
        return f"rows {len(got)} vs {len(want)}; only spark {sorted(a)[:3]}; only sql {sorted(b)[:3]}", len(got)
    return None, len(got)


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from conftest import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                t0 = time.time()
                problem, n = compare(fn(spark, folder), con, oracles[name])
            else:
                problem, n = None, fn(spark, folder).count()
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += problem is not None
        print(f"@@ {'BAD' if problem else 'ok '} {name} rows={n} {time.time() - t:.1f}s {'' if name in oracles else '(rows only)'} {(problem or '')[:1100]}", flush=True)
    print("@@ failures:", bad)
