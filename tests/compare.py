"""Run registered queries and their SQL twins side by side.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str | None):
    """(problem or None, rows, Spark seconds, SQL seconds)."""
    t0 = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return None, len(got[1]), t1 - t0, 0.0
    result = con.execute(sql)
    types = type_differences(df, result.description)
    want = rows_of([c[0] for c in result.description], result.fetchall())
    t2 = time.time()
    problem = None
    if got[0] != want[0]:
        problem = f"columns {got[0]} != {want[0]}"
    elif len(got[1]) != len(want[1]):
        problem = f"rows {len(got[1])} != {len(want[1])}"
    if problem is None and got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        problem = f"{len(bad)} rows differ, e.g. {bad[0]}"
    elif problem and got[0] == want[0]:
        a, b = set(got[1]), set(want[1])
        problem += f"; only Spark {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"
    if problem is None and types:
        problem = f"types {types}"
    return problem, len(got[1]), t1 - t0, t2 - t1


# Spark type -> DuckDB types that mean the same.
SAME_TYPE = {
    "string": {"VARCHAR"}, "int": {"INTEGER"}, "bigint": {"BIGINT"}, "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"}, "timestamp_ntz": {"TIMESTAMP"}, "timestamp": {"TIMESTAMP WITH TIME ZONE"},
}


def type_differences(df, description) -> list[str]:
    theirs = {c[0]: str(c[1]) for c in description}
    return [
        f"{name}: {kind} / {theirs.get(name)}"
        for name, kind in df.dtypes
        if theirs.get(name) not in SAME_TYPE.get(kind, set())
    ]


def local_session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = local_session(), oracle_connection(sf_dir)
    failed = 0
    for name in names:
        try:
            problem, n, spark_s, sql_s = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            problem, n, spark_s, sql_s = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0, 0.0
        failed += problem is not None
        state = "FAIL" if problem else "ok" if name in oracles else "rows"
        print(f"{state:5}{name:34}{n:8}{spark_s:8.2f}{sql_s:8.2f}  {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main()
