"""Compare registered queries with their SQL oracles in DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    return value


def duck_types(con, sql):
    return {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}


SAME_TYPE = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def compare(spark, con, plan, sql, folder):
    """None when rows and types agree, else a short report."""
    df = plan(spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(normal(r[n]) for n in names) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != names:
        return f"columns {names} != {sorted(columns)}"
    order = [columns.index(n) for n in names]
    want = sorted((tuple(normal(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 50000 else []
        missing = [r for r in want if r not in set(got)][:3] if len(want) < 50000 else []
        return f"{len(got)} rows != {len(want)}; extra {extra}; missing {missing}"
    for a, b in zip(got, want):
        if a != b:
            return f"{names}: {a} != {b}"
    types = duck_types(con, sql)
    spark_types = dict(df.dtypes)
    wrong = [
        (n, spark_types[n], types[n]) for n in names if SAME_TYPE.get(spark_types[n], types[n]) != types[n]
    ]
    return f"types {wrong}" if wrong else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from meterframe.session import build_session

    import __spark_entry__ as entry

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = build_session("oracle", "local[8]", 8, {"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, plan in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            if name in oracles:
                report = compare(spark, con, plan, oracles[name], folder)
            else:
                report = None if plan(spark, folder).count() else "no rows"
        except Exception as error:
            report = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += report is not None
        print(f"{name:36s} {time.time() - begin:6.2f}s {'ok' if report is None else 'FAIL ' + report}", flush=True)
    print("failed:", bad)
