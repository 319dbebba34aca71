"""python tests/check_sql.py DIR [NAME...]: queries against their SQL in DuckDB, as rows sorted by all columns."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{src}')")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    """(same, note)"""
    t = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t = time.time() - t
    if sql is None:
        return None, f"{len(got)} rows, no SQL, {t:.1f} s"
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    want = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(cols)}"
    if got == want:
        return True, f"{len(got)} rows, {t:.1f} s"
    a, b = set(got) - set(want), set(want) - set(got)
    return False, f"{len(got)} rows against {len(want)}; only Spark {list(a)[:3]}; only SQL {list(b)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from lexspark.session import build_session

    spark = build_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sys.argv[1])
    q, s = e.queries(), e.oracle_sql()
    bad = 0
    for n in sys.argv[2:] or q:
        try:
            ok, note = compare(spark, con, sys.argv[1], n, q[n], s.get(n))
        except Exception as x:  # noqa: BLE001
            ok, note = False, f"{type(x).__name__}: {str(x)[:600]}"
        bad += ok is False
        print({True: "same", False: "DIFFERENT", None: "rows"}[ok], n, note, flush=True)
    sys.exit(bad > 0)
