"""Side-by-side comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import glob
import math
import os

import duckdb
from pyspark.sql import SparkSession

from tidelog.session import configure


def local_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidelog-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"create view {name} as select * from '{path}'")
    return db


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return "NaN" if math.isnan(value) else repr(round(value, 6) + 0.0)
        if isinstance(value, bool) or value is None:
            return repr(value)
        return f"{type(value).__name__}:{value}"

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(df, db, sql: str | None) -> str:
    names = df.columns
    got = canonical(df.collect(), names)
    if sql is None:
        return f"ok rows only {len(got)}"
    found = db.execute(sql)
    want_names = [d[0] for d in found.description]
    want = canonical(found.fetchall(), want_names)
    if sorted(names) != sorted(want_names):
        return f"COLUMNS {sorted(names)} != {sorted(want_names)}"
    if got != want:
        missing = [r for r in want if r not in set(got)][:3]
        extra = [r for r in got if r not in set(want)][:3]
        return f"DIFFERENT {len(got)} rows, expected {len(want)}\n  {sorted(names)}\n  missing {missing}\n  extra {extra}"
    return f"ok {len(got)}" if got else "EMPTY"
