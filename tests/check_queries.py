"""Compare registered queries with their SQL in DuckDB: python tests/check_queries.py SF_DIR [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    return a == b


def compare(spark, connection, name: str, query, sql: str, sf_dir: str) -> str:
    """What differs, or nothing."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    key = lambda r: [(x is None, f"{x:.6f}" if isinstance(x, float) else str(x)) for x in r]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        if not all(map(same, a, b)):
            return f"{a} and {b}"
    return ""


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", 8).config("spark.ui.enabled", False).config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", False).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, oracle, sf_dir = entry.queries(), entry.oracle_sql(), sys.argv[1]
    connection = connect(sf_dir)
    for name in sys.argv[2:] or [n for n in queries if n in oracle]:
        began = time.time()
        try:
            said = compare(spark, connection, name, queries[name], oracle[name], sf_dir)
        except Exception as e:  # report and go on to the next
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{'ok  ' if not said else 'DIFF'} {name} {time.time() - began:.1f} s {said}", flush=True)
