"""Run queries against DuckDB: ``python -m tests.compare FOLDER [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(row) for row in df.select(*[df[f"`{name}`"] for name in names]).collect())


def oracle_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = connection.execute(sql)
    columns = [column[0] for column in result.description]
    order = sorted(range(len(columns)), key=lambda position: columns[position])
    rows = Counter(tuple(row[position] for position in order) for row in result.fetchall())
    return [columns[position] for position in order], rows


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """Row count and a few examples of rows only one side has."""
    names, ours = spark_rows(df)
    expected_names, expected = oracle_rows(connection, sql)
    if names != expected_names:
        return ours.total(), [f"columns {names} != {expected_names}"]
    extra, missing = ours - expected, expected - ours
    examples = [f"only spark  {row}" for row in sorted(extra, key=repr)[:3]]
    examples += [f"only duckdb {row}" for row in sorted(missing, key=repr)[:3]]
    if extra or missing:
        examples.append(f"{extra.total()} extra, {missing.total()} missing")
    return ours.total(), examples


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import build_session

    folder, *names = sys.argv[1:]
    spark = build_session()
    connection = oracle(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        started = time.time()
        if name not in sql:
            print(f"{name:30s} {queries[name](spark, folder).count():8d} rows, no SQL")
            continue
        try:
            rows, found = differences(queries[name](spark, folder), connection, sql[name])
        except Exception as error:
            rows, found = -1, [repr(error)[:1500]]
        print(f"{name:30s} {rows:8d} rows {time.time() - started:6.1f}s {'ok' if not found else 'DIFFERS'}", flush=True)
        for line in found:
            print("   ", line[:700])


if __name__ == "__main__":
    main()
