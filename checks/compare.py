"""Run registered queries and their SQL side by side.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import re
import sys
import tempfile
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import oracle_sql
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("emberscope")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="emberscope-checks-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def check(spark: SparkSession, con, sf_dir: str, name: str, sql: str) -> tuple[bool, str, float]:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    plan = df._jdf.queryExecution().executedPlan().toString()
    crossed = re.findall(r"(?m)^[\s:+*()\d-]*(CartesianProduct|BroadcastNestedLoopJoin)\b", plan)
    if crossed:
        return False, f"plan has {crossed}", took
    want = con.execute(sql)
    want_columns = [d[0] for d in want.description]
    want_types = [str(d[1]) for d in want.description]
    if sorted(want_columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(want_columns)}", took
    spark_types = dict(df.dtypes)
    names = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    off = [
        f"{c}:{spark_types[c]}/{t}" for c, t in zip(want_columns, want_types)
        if names.get(spark_types[c], spark_types[c]) != t
    ]
    got, expected = rows_of(df.columns, got_rows), rows_of(want_columns, want.fetchall())
    if got != expected:
        extra, missing = list((got - expected).items())[:2], list((expected - got).items())[:2]
        return False, f"{sum(got.values())} rows vs {sum(expected.values())}\n   spark only {extra}\n   sql only {missing}", took
    return True, f"{sum(got.values())} rows" + (f" TYPES {off}" if off else ""), took


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, sqls = session(), duck(sf_dir), oracle_sql()
    failed = 0
    for name in sys.argv[2:] or QUERIES:
        try:
            if name not in sqls:
                start = time.time()
                n = QUERIES[name](spark, sf_dir).count()
                ok, note, took = True, f"{n} rows, no SQL", time.time() - start
            else:
                ok, note, took = check(spark, con, sf_dir, name, sqls[name])
        except Exception as error:  # report and go on with the other queries
            ok, note, took = False, str(error)[:400], 0.0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:36s} {took:6.2f}s {note}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
