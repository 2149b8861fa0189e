"""Run queries beside their SQL counterparts and compare rows: check_oracles.py FOLDER [NAME ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewright.catalog import ORACLES, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_by_name(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(picked, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def differences(spark, con, folder: str, name: str) -> str | None:
    df = QUERIES[name](spark, folder)
    ours = rows_by_name(df.columns, df.collect())
    if name not in ORACLES:
        return None if ours else "no rows"
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    theirs = rows_by_name(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs, strict=True):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            return f"{a} against {b}"
    return None


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), []
    for name in names:
        started = time.time()
        try:
            wrong = differences(spark, con, folder, name)
        except Exception as exc:  # noqa: BLE001 - report and go on to the next query
            wrong = f"{type(exc).__name__}: {str(exc)[:600]}"
        mark = "ok" if wrong is None else "BAD"
        print(f"{mark:4}{name:28}{time.time() - started:7.1f}s  {'' if name in ORACLES else 'rows only'} {wrong or ''}", flush=True)
        if wrong:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
