"""Run registered queries beside their SQL twins: ``python -m casebook.compare [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

import casebook
from surveykit.session import build_session


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(os.path.join(sf, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int,)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        return float(v) if v.__class__.__name__ == "Decimal" else v
    except Exception:
        return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, name):
    t = time.time()
    df = casebook.QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if name not in casebook.SQL:
        return f"rows={len(got)} (no sql)", took, len(got) > 0
    cur = con.execute(casebook.SQL[name])
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}", took, False
    if got == want:
        types = {str(d[1]) for d in cur.description}
        note = " HUGEINT" if any("HUGE" in x or "DECIMAL" in x for x in types) else ""
        return f"ok rows={len(got)}{note}", took, len(got) > 0
    diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return f"DIFF rows {len(got)} vs {len(want)} cols {sorted(cols)}: {diff}", took, False


def main(argv):
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    casebook.load_all()
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    names = argv or list(casebook.QUERIES)
    bad = 0
    for n in names:
        matches = [n] if n in casebook.QUERIES else [q for q in casebook.QUERIES if casebook.QUERIES[q].__module__.endswith("." + n)]
        for q in matches:
            try:
                msg, took, ok = compare(spark, con, sf, q)
            except Exception as e:  # report and go on
                msg, took, ok = f"ERROR {type(e).__name__}: {str(e)[:700]}", 0, False
            bad += not ok
            print(f"{'  ' if ok else '!!'} {q:28s} {took:6.2f}s {msg}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
