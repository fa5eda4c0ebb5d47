"""Run registered queries in Spark and their SQL in DuckDB; compare like the driver.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
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
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    # exact: both sides already round their outputs to 6 digits, so the values
    # must agree bit for bit, as a value hash would require
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN"}


def compare(spark, sf_dir, names=None):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
            stypes = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK-ERROR", repr(e)[:400])
            continue
        ts = time.time() - t0
        if name not in sql:
            results[name] = ("rows-only", len(srows), round(ts, 2))
            continue
        t0 = time.time()
        try:
            rel = con.sql(sql[name])
            dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
            drows = rel.fetchall()
            dcols = list(rel.columns)
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL-ERROR", repr(e)[:400])
            continue
        td = time.time() - t0
        ok_cols = sorted(scols) == sorted(dcols) and stypes == dtypes
        a, b = canon(srows, scols), canon(drows, dcols)
        same = a == b
        detail = ""
        if not same:
            sa, sb = set(a), set(b)
            detail = f" only_spark={list(sa - sb)[:2]} only_sql={list(sb - sa)[:2]}"
        results[name] = ("OK" if (ok_cols and same) else "MISMATCH",
                         f"rows {len(srows)}/{len(drows)} cols_ok={ok_cols} spark {ts:.1f}s sql {td:.1f}s"
                         + ("" if ok_cols else f" {stypes} vs {dtypes}") + detail)
    return results


if __name__ == "__main__":
    from vecbench.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    for k, v in compare(spark, sf, names).items():
        print(k, *v)
