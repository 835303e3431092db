"""Run queries in Spark and their SQL in DuckDB and compare whole results."""
from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def difference(df, con, sql: str) -> str:
    """Empty if equal, else a short description."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = [tuple(r) for r in df.collect()]
    a, b = table(df.columns, got), table(names, want)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"rows {len(a)} / {len(b)}, {len(only_a)} differ\n  {sorted(names)}\n  spark {only_a[:2]}\n  duck  {only_b[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir, wanted = f"/root/testdata/sf{sys.argv[1]}", sys.argv[2:]
    settings = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        **dict(kv.split("=", 1) for kv in os.environ.get("COMPARE_CONF", "").split() if kv),
    }
    spark = SparkSession.builder.master("local[8]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if wanted and wanted[0].isdigit():
        spark.conf.set("spark.pitchframe.maxGroupRows", wanted.pop(0))
    con, oracles = duck(sf_dir), e.oracle_sql()
    bad = 0
    for name, query in e.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            result = difference(df, con, oracles[name]) if name in oracles else f"-- {df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(result) and not result.startswith("--")
        print(f"{name:32s} {time.time() - start:6.2f}s {result or 'equal'}", flush=True)
    print("different:", bad)
