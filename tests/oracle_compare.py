"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python -m tests.oracle_compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys
import time

import duckdb

from courtside.sources.fixtures import BASE_TABLES


def duck_conn(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def _digest(rows):
    h = hashlib.sha1()
    for r in rows:
        h.update(repr(r).encode())
    return h.hexdigest()


def compare(spark, con, name: str, sf_dir: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    out = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    out["duck_rows"] = len(drows)
    a, b = _rows(scols, srows), _rows(dcols, drows)
    out["schema_ok"] = sorted(scols) == sorted(dcols)
    out["rows_ok"] = len(a) == len(b)
    out["hash_ok"] = _digest(a) == _digest(b)
    out["status"] = "ok" if out["schema_ok"] and out["rows_ok"] and out["hash_ok"] else "MISMATCH"
    if out["status"] != "ok":
        out["spark_cols"] = sorted(scols)
        out["duck_cols"] = sorted(dcols)
        sa, sb = set(a), set(b)
        out["only_spark"] = list(sa - sb)[:3]
        out["only_duck"] = list(sb - sa)[:3]
    return out


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from courtside.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session("local[8]", 8)
    con = duck_conn(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        try:
            r = compare(spark, con, name, sf_dir, qs[name], os_.get(name))
        except Exception as e:  # report and go on
            r = {"name": name, "status": "ERROR", "error": str(e)[:800]}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names or qs) - bad} fine, {bad} bad")


if __name__ == "__main__":
    main(sys.argv)
