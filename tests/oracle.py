"""Compare every query that has SQL with DuckDB over the same Parquet files."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day).isoformat()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf, name, make, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    df = make(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want, strict=False) if g != w][:2]
        return f"{len(got)} rows, {len(want)} wanted; first differences {str(diff)[:500]}"
    return None


def main(sf: str, only: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in q:
        if (only and not any(name.startswith(x) for x in only)) or (not only and (name.startswith("op") or name == "pipeline")):
            continue
        t = time.time()
        try:
            said = compare(spark, sf, name, q[name], o[name]) if name in o else f"rows {q[name](spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"error {str(e)[:400]}"
        bad += bool(said) and not said.startswith("rows ")
        if said or time.time() - t > 20:
            print(name, said, round(time.time() - t, 1), flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
