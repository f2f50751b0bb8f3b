"""Run registered queries and their SQL side by side: python -m registry.check [sf_dir] [name prefix...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

from registry import load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
            v = int(v)
        return repr(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[str, float]:
    start = time.time()
    out = fn(spark, sf_dir).toPandas()
    took = time.time() - start
    spark.catalog.clearCache()
    if sql is None:
        return f"rows only ({len(out)})", took
    want = con.execute(sql).fetchdf()
    if sorted(out.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(out.columns)} / {sorted(want.columns)}", took
    a, b = canonical(out), canonical(want)
    if a != b:
        gap = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"DIFFER {len(a)}/{len(b)} rows, e.g. {gap}", took
    return f"ok ({len(a)})", took


def main(argv):
    from pyspark.sql import SparkSession

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sql = load()
    bad = 0
    for name, fn in queries.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            verdict, took = compare(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as e:  # report and go on to the next query
            verdict, took = f"FAILED {type(e).__name__}: {str(e)[:600]}", 0.0
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{took:7.2f}s {name}: {verdict}", flush=True)
    print(f"{bad} not matching")


if __name__ == "__main__":
    main(sys.argv[1:])
