"""Run registered Spark queries and their DuckDB oracle side by side.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def frame_rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(v) for v in rec) for rec in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return {"name": name, "status": "rows-only", "rows": len(spdf), "sec": round(t1 - t0, 2)}
    opdf = con.execute(sql).df()
    sc, sr = frame_rows(spdf)
    oc, orows = frame_rows(opdf)
    res = {"name": name, "rows": len(sr), "oracle_rows": len(orows), "sec": round(t1 - t0, 2)}
    if sc != oc:
        res["status"] = "SCHEMA"
        res["detail"] = f"spark={sc} oracle={oc}"
    elif len(sr) != len(orows):
        res["status"] = "ROWCOUNT"
    elif sr != orows:
        bad = [(a, b) for a, b in zip(sr, orows) if a != b][:2]
        res["status"] = "VALUES"
        res["detail"] = str(bad)[:600]
    else:
        res["status"] = "ok"
    return res


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    import __spark_entry__ as E
    from arealens.session import get_spark
    spark = get_spark()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            res = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and continue
            res = {"name": name, "status": "ERROR", "detail": repr(e)[:800]}
        bad += res["status"] not in ("ok", "rows-only")
        print(res, flush=True)
    print(f"done: {bad} problems")


if __name__ == "__main__":
    main()
