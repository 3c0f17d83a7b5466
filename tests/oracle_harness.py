"""Run registered queries on Spark and their SQL oracle on DuckDB, compare.

Comparison: same column names, same row count, and the same multiset of
rows after normalising values (NULL/NaN/NaT to None, numbers to int or
rounded float, temporal values to ISO text, nested values to tuples).

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def duckdb_conn(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime,)):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if type(v).__name__ in ("NaTType",):
        return None
    if type(v).__name__ == "Timestamp":
        return v.to_pydatetime().isoformat(sep=" ")
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    out.sort(key=repr)
    return [columns[i] for i in order], out


def spark_rows(df):
    cols = df.columns
    return rows_of(cols, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return rows_of(cols, cur.fetchall())


def compare(spark, name, sf_dir, con=None):
    from campusledger.plans import ORACLE, QUERIES, load_all
    load_all()
    con = con or duckdb_conn(sf_dir)
    t0 = time.time()
    s_cols, s_rows = spark_rows(QUERIES[name](spark, sf_dir))
    t1 = time.time()
    if name not in ORACLE:
        return {"name": name, "ok": None, "rows": len(s_rows), "spark_s": t1 - t0}
    d_cols, d_rows = duck_rows(con, ORACLE[name])
    problems = []
    if s_cols != d_cols:
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    elif s_rows != d_rows:
        diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
        problems.append(f"values differ, e.g. {diff}")
    return {"name": name, "ok": not problems, "rows": len(s_rows), "problems": problems,
            "spark_s": round(t1 - t0, 2)}


def main(argv):
    from campusledger.session import get_session
    from campusledger.plans import QUERIES, load_all
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    load_all()
    names = argv[2:] or sorted(QUERIES)
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_conn(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "ok": False, "problems": [f"{type(e).__name__}: {str(e)[:400]}"]}
        if r["ok"] is False:
            bad += 1
        print(("OK  " if r["ok"] else "--  " if r["ok"] is None else "BAD ") + n,
              r.get("rows"), r.get("spark_s"), "; ".join(r.get("problems", [])), flush=True)
    print(f"{len(names) - bad}/{len(names)} without mismatch")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
