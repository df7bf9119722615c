"""Run registered queries in Spark and their SQL oracle in DuckDB; compare.

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from pitchline.sources.tables import TABLES  # noqa: E402


def normalise(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_float_dtype(s):
            df[c] = s.map(lambda v: None if pd.isna(v) else
                          (str(int(v)) if float(v).is_integer() and abs(v) < 2**53 else repr(float(v) + 0.0)))
        elif pd.api.types.is_integer_dtype(s) or pd.api.types.is_bool_dtype(s):
            df[c] = s.map(lambda v: None if pd.isna(v) else str(int(v)))
        elif pd.api.types.is_datetime64_any_dtype(s):
            df[c] = s.map(lambda v: None if pd.isna(v) else pd.Timestamp(v).isoformat())
        else:
            df[c] = s.map(lambda v: None if v is None or (isinstance(v, float) and pd.isna(v)) else
                          ((str(int(v)) if v.is_integer() else repr(v + 0.0)) if isinstance(v, float) else str(v)))
    df = df.astype(object).where(df.notna(), "<null>")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    from pitchline.plans.registry import ORACLE, QUERIES
    con = duck(sf_dir)
    results = {}
    for name in names or list(QUERIES):
        t0 = time.time()
        try:
            sp = QUERIES[name](spark, sf_dir).toPandas()
        except Exception as e:  # report and continue
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        t1 = time.time()
        if name not in ORACLE:
            results[name] = f"rows-only ({len(sp)} rows)"
            print(f"{name:28s} {results[name]}  spark {t1 - t0:.1f}s", flush=True)
            continue
        try:
            od = con.sql(ORACLE[name]).df()
        except Exception as e:
            results[name] = f"SQL ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        t2 = time.time()
        if sorted(sp.columns) != sorted(od.columns):
            results[name] = f"COLUMNS {sorted(set(sp.columns) ^ set(od.columns))}"
        elif len(sp) != len(od):
            results[name] = f"ROWS spark={len(sp)} sql={len(od)}"
        else:
            a, b = normalise(sp), normalise(od)
            bad = [c for c in a.columns if not (a[c] == b[c]).all()]
            results[name] = "OK" if not bad else f"VALUES differ in {bad[:6]}"
            if bad and verbose:
                c = bad[0]
                diff = (a[c] != b[c])
                print(pd.DataFrame({"spark": a[c][diff].head(5), "sql": b[c][diff].head(5)}))
        print(f"{name:28s} {results[name]}  rows={len(sp)} spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s", flush=True)
    return results


if __name__ == "__main__":
    from pitchline.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, names)
    ok = sum(1 for v in res.values() if v == "OK")
    print(f"{ok}/{len(res)} OK")
