"""Run registered queries and compare them with their DuckDB twins.

    python tools/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from shelfwise.catalog import load  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return repr(0.0 if value == 0 else value)
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def compare(spark, con, folder, name, fn, sql) -> str:
    started = time.time()
    got = fn(spark, folder).toPandas()
    took = time.time() - started
    if sql is None:
        return f"ROWS  {name}: {len(got)} rows, {took:.1f}s"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL  {name}: columns {sorted(set(got.columns) ^ set(want.columns))}"
    kinds = [(c, str(got[c].dtype), str(want[c].dtype)) for c in sorted(got.columns)
             if str(got[c].dtype).split('[')[0].rstrip("0123456789") != str(want[c].dtype).split('[')[0].rstrip("0123456789")]
    a, b = rows(got), rows(want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"FAIL  {name}: {len(a)} vs {len(b)} rows\n   cols {sorted(got.columns)}\n   spark  {only_a}\n   duckdb {only_b}"
    note = "" if len(a) else " EMPTY"
    note += f" TYPES {kinds}" if kinds else ""
    return f"ok    {name}: {len(a)} rows, {took:.1f}s{note}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    book = load()
    failed = 0
    for name in args.names or list(book.queries):
        try:
            line = compare(spark, con, folder, name, book.queries[name], book.oracles.get(name))
        except Exception as exc:  # report and go on with the next query
            line = f"ERROR {name}: {type(exc).__name__}: {str(exc)[:900]}"
        failed += not line.startswith(("ok", "ROWS"))
        print(line, flush=True)
    print(f"{failed} problems")


if __name__ == "__main__":
    main()
