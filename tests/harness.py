"""Run registered queries and their SQL twins side by side."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb
import pandas as pd


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if hasattr(v, "item"):
        return _cell(v.item())
    return v


def _rows(pdf: pd.DataFrame):
    pdf = pdf[sorted(pdf.columns)]
    rows = [tuple(_cell(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x).__name__) if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in r))


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str:
    """'' when equal, else a short description of the first difference."""
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = _rows(spark_pdf), _rows(duck_pdf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    return ""


def run_one(spark, con, sf_dir, name, fn, sql):
    t = time.time()
    pdf = fn(spark, sf_dir).toPandas()
    took = time.time() - t
    if sql is None:
        return ("ROWS" if len(pdf) else "EMPTY"), len(pdf), took, ""
    t = time.time()
    duck = con.execute(sql).df()
    diff = compare(pdf, duck)
    types = {c: (str(pdf[c].dtype), str(duck[c].dtype)) for c in pdf.columns if c in duck.columns and str(pdf[c].dtype) != str(duck[c].dtype)}
    return ("OK" if not diff else "DIFF"), len(pdf), took, diff + (f" types {types}" if types else "")


if __name__ == "__main__":
    import sys
    import traceback

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from riskframe.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    want = sys.argv[1:]
    import signal

    def stop(*_):
        raise TimeoutError("query took too long")

    signal.signal(signal.SIGALRM, stop)
    limit = int(os.environ.get("LIMIT", "90"))
    for name, fn in qs.items():
        if name in os.environ.get("SKIP", "").split(","):
            continue
        signal.alarm(limit)
        if want and not any(w in name for w in want):
            continue
        try:
            s, n, t, msg = run_one(spark, con, sf, name, fn, sqls.get(name))
            print(f"{s:5} {t:6.2f}s {n:8d} {name} {msg[:600]}", flush=True)
        except Exception as x:
            spark.sparkContext.cancelAllJobs()
            print(f"FAIL  {name}: {str(x)[:900]}", flush=True)
            if os.environ.get("TB"):
                traceback.print_exc()
