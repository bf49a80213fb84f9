"""Run registered queries against their SQL counterparts: ``python -m checks.compare [folder] [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from checks import oracle, queries
from weblode.session import session

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(normal(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=repr)


SAME_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def types_of(frame, connection, sql: str) -> dict:
    """Columns whose types differ."""
    described = {row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    return {
        name: (kind, described[name]) for name, kind in frame.dtypes if SAME_TYPE.get(kind) != described[name]
    }


def compare(spark, folder: str, names: list[str]) -> dict[str, str]:
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    sql, found = oracle.oracle_sql(), {}
    for name in names:
        start = time.time()
        try:
            frame = queries.QUERIES[name](spark, folder)
            got = rows_of(frame.columns, frame.collect())
        except Exception as error:  # noqa: BLE001
            found[name] = f"spark: {str(error)[:300]}"
            continue
        took = time.time() - start
        if name not in sql:
            found[name] = f"rows only: {len(got[1])}"
            continue
        try:
            cursor = connection.execute(sql[name])
            wanted = rows_of([d[0] for d in cursor.description], cursor.fetchall())
        except Exception as error:  # noqa: BLE001
            found[name] = f"sql: {str(error)[:300]}"
            continue
        if got == wanted:
            kinds = types_of(frame, connection, sql[name])
            found[name] = f"types {kinds}" if kinds else f"ok {len(got[1])} rows {took:.2f}s"
        elif got[0] != wanted[0]:
            found[name] = f"columns {got[0]} / {wanted[0]}"
        else:
            differing = next(((a, b) for a, b in zip(got[1], wanted[1]) if a != b), None)
            found[name] = f"rows {len(got[1])} / {len(wanted[1])}: {str(differing)[:600]}"
    return found


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries.QUERIES)
    spark = session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    results = compare(spark, folder, names)
    for name, result in results.items():
        print(f"{name:28s} {result}")
    print("not ok:", [n for n, r in results.items() if not r.startswith("ok")])
