"""Run registered queries against their DuckDB oracles: python tests/compare.py [folder] [name prefix ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores: int = 8, partitions: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("barwright")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.sql.adaptive.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) == "boolean":
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
    keys = sorted(df.columns, key=lambda c: (df[c].dtype.kind == "f", c))
    return df.sort_values(keys, na_position="last").reset_index(drop=True)


def differences(a: pd.DataFrame, b: pd.DataFrame) -> list[str]:
    """Empty when both frames hold the same values in some order."""
    if sorted(a.columns) != sorted(b.columns):
        return [f"columns {sorted(a.columns)} != {sorted(b.columns)}"]
    if len(a) != len(b):
        return [f"rows {len(a)} != {len(b)}"]
    a, b, bad = _canon(a), _canon(b), []
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind in "fiu" and y.dtype.kind in "fiu":
            if (x.dtype.kind == "f") != (y.dtype.kind == "f") and not x.isna().any() and not y.isna().any():
                bad.append(f"{c}: type {x.dtype} != {y.dtype}")
            x, y = x.astype(float).to_numpy(), y.astype(float).to_numpy()
            ne = ~((x == y) | (np.isnan(x) & np.isnan(y)))
            if ne.any():
                d = np.abs(x[ne] - y[ne])
                k = np.flatnonzero(ne)[0]
                bad.append(f"{c}: {ne.sum()} differ, max {np.nanmax(d) if not np.isnan(d).all() else 'null'}, first {x[k]} vs {y[k]}")
        else:
            ne = ~((x == y) | (x.isna() & y.isna()))
            if ne.any():
                k = np.flatnonzero(ne)[0]
                bad.append(f"{c}: {ne.sum()} differ, first {x[k]!r} vs {y[k]!r} ({x.dtype}/{y.dtype})")
    return bad


def main() -> None:
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    spark, con = session(), oracle(folder)
    qs, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not args or any(n.startswith(a) for a in args)]
    failed = []
    for n in names:
        start = time.time()
        try:
            got = qs[n](spark, folder).toPandas()
            took = time.time() - start
            if n not in sql:
                print(f"rows {n:34s} {len(got):7d} {took:6.2f}s", flush=True)
                if not len(got):
                    failed.append(n)
                continue
            bad = differences(got, con.execute(sql[n]).df())
            nulls = [c for c in got.columns if len(got) and got[c].isna().all()]
            note = f" all-null {nulls}" if nulls else ""
            print(f"{'ok  ' if not bad else 'DIFF'} {n:34s} {len(got):7d} {took:6.2f}s{note}", flush=True)
            for b in bad:
                print("      ", b)
        except Exception as e:
            bad = [str(e)]
            print(f"ERR  {n}: {str(e)[:1200]}", flush=True)
        if bad:
            failed.append(n)
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}")


if __name__ == "__main__":
    main()
