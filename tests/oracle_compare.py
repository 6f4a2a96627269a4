"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]

Comparison: same row count, same column names, and equal values after
sorting columns by name and rows by all columns; floats are compared after
rounding to 6 decimals.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6) + 0.0
    except Exception:
        pass
    if type(v).__name__ == "Row":
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf_dir, keys=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for k in (keys or sorted(qs)):
        t0 = time.time()
        df = qs[k](spark, sf_dir)
        srows = [tuple(r) for r in df.collect()]
        scols = df.columns
        ts = time.time() - t0
        if k not in sqls:
            results[k] = ("rows-only", len(srows))
            if verbose:
                print(f"{k:32s} rows-only  n={len(srows)}  {ts:.1f}s", flush=True)
            continue
        rel = con.sql(sqls[k])
        dcols = rel.columns
        drows = rel.fetchall()
        ok_cols = sorted(scols) == sorted(dcols)
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        ok = ok_cols and a == b
        nbad = None
        if not ok and ok_cols and len(a) == len(b):
            nbad = sum(x != y for x, y in zip(a, b))
        results[k] = ("ok" if ok else "MISMATCH", len(srows), len(drows))
        if verbose:
            print(f"{k:32s} {'ok' if ok else 'MISMATCH'}  spark={len(srows)} duck={len(drows)}"
                  f"{'' if ok_cols else f' cols {sorted(scols)} vs {sorted(dcols)}'}"
                  f"{'' if nbad is None else f' bad_rows={nbad}'}  {ts:.1f}s", flush=True)
            if not ok and ok_cols and len(a) == len(b):
                for x, y in zip(a, b):
                    if x != y:
                        print("   spark:", x)
                        print("   duck :", y)
                        break
    return results


if __name__ == "__main__":
    from clickpair.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = get_spark(master="local[8]", shuffle_partitions=8,
                      extra={"spark.driver.memory": "8g"})
    res = compare(spark, sf, keys)
    bad = [k for k, v in res.items() if v[0] == "MISMATCH"]
    print("MISMATCHES:", bad)
