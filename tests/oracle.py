"""Run registered queries in Spark and their SQL in DuckDB and compare them.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("seriesloom-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df.reindex(sorted(df.columns), axis=1)
    out = {}
    for c in df.columns:
        s = df[c]
        if s.dtype.kind == "f":
            out[c] = s.map(lambda v: None if v != v else repr(float(v) + 0.0))
        elif s.dtype.kind == "M":
            out[c] = s.map(lambda v: None if v is pd.NaT else pd.Timestamp(v).isoformat())
        else:
            out[c] = s.map(_cell)
    res = pd.DataFrame(out, dtype=object)
    res = res.astype(str)
    return res.sort_values(list(res.columns)).reset_index(drop=True) if len(res.columns) else res


def _cell(v):
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def _kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(df[c].dtype) for c in sorted(df.columns)}


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    a, b = _canon(spark_df), _canon(sql_df)
    if a.equals(b):
        return None
    msgs = []
    for c in a.columns:
        d = (a[c] != b[c])
        if d.any():
            i = d.idxmax()
            msgs.append(f"{c}: {int(d.sum())} differ, first {a[c][i]!r} vs {b[c][i]!r}")
    return "; ".join(msgs[:6])


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--match", default="")
    args = ap.parse_args()
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = args.names or [n for n in queries if args.match in n]
    bad = 0
    for n in names:
        t = time.time()
        try:
            got = queries[n](spark, sf_dir).toPandas()
            took = time.time() - t
            if n not in oracles:
                print(f"ROWS {n}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            want = con.execute(oracles[n]).df()
            diff = compare(got, want)
            if diff is None and len(got) == 0:
                diff = "no rows"
            kinds = {
                c: (k, _kinds(want)[c]) for c, k in _kinds(got).items() if k != _kinds(want).get(c)
            } if diff is None else {}
            print(f"{'ok  ' if diff is None else 'FAIL'} {n}: {len(got)} rows, {took:.1f}s {diff or ''} {kinds or ''}", flush=True)
            bad += diff is not None
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {n}: {type(e).__name__}: {str(e)[:700]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
