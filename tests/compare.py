"""Compare registered queries with their DuckDB counterparts.

Usage: python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Families of types that count as equal.
SPARK_KINDS = {
    "bigint": "bigint", "int": "int", "smallint": "int", "double": "double", "float": "float", "string": "text",
    "boolean": "bool", "timestamp_ntz": "time", "timestamp": "time", "date": "date",
}
DUCK_KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "SMALLINT": "int", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "text",
    "BOOLEAN": "bool", "TIMESTAMP": "time", "DATE": "date",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(df, connection, sql: str) -> list[str]:
    """Ways in which a Spark result and an SQL result differ; empty when they agree."""
    relation = connection.sql(sql)
    ours = {f.name: SPARK_KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    theirs = dict(
        zip(relation.columns, [DUCK_KINDS.get(str(t), str(t)) for t in relation.types], strict=True)
    )
    found = []
    if ours != theirs:
        found.append(f"types {sorted(ours.items() - theirs.items())} against {sorted(theirs.items() - ours.items())}")
        if sorted(ours) != sorted(theirs):
            return found
    a = rows_of(df.columns, df.collect())
    b = rows_of(relation.columns, connection.execute(sql).fetchall())
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        found.append(f"{len(a)} against {len(b)} rows; only Spark {only_a}; only SQL {only_b}")
    return found


def main() -> None:
    import __spark_entry__ as registered

    from ratewright.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = registered.queries(), registered.oracle_sql()
    connection = duck(folder)
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                found = differences(df, connection, sql[name])
                n = ""
            else:
                found, n = [], f" {df.count()} rows"
            print(f"{'DIFF' if found else 'ok':5}{name:32}{time.time() - start:7.2f}s{n}", *found, flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name:32}{time.time() - start:7.2f}s {type(error).__name__}: {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
