"""Run queries and their SQL side by side and report differences."""

import math
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def cell(value) -> str:
    if value is None:
        return "∅"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


# DuckDB's name of each Spark type that queries return.
TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def canonical(columns, rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(actual: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both hold the same rows, else what differs first."""
    expected = connection.execute(sql)
    names, wanted = canonical([d[0] for d in expected.description], expected.fetchall())
    columns, rows = canonical(actual.columns, [tuple(r) for r in actual.collect()])
    if names != columns:
        return f"columns {columns} instead of {names}"
    kinds = {d[0]: str(d[1]) for d in expected.description}
    odd = [f"{c} {t}/{kinds[c]}" for c, t in actual.dtypes if TYPES.get(t) != kinds[c]]
    if odd:
        return f"types {odd}"
    if len(rows) != len(wanted):
        return f"{len(rows)} rows instead of {len(wanted)}"
    for ours, theirs in zip(rows, wanted):
        if ours != theirs:
            return f"{ours} instead of {theirs}"
    return None


def main(sf_dir: str, *keys: str) -> int:
    from verification.oracles import ORACLES
    from verification.queries import QUERIES

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = connect(sf_dir), 0
    for key in keys or QUERIES:
        start = time.time()
        try:
            if key in ORACLES:
                problem = difference(QUERIES[key](spark, sf_dir), connection, ORACLES[key])
            else:
                problem = None if QUERIES[key](spark, sf_dir).count() >= 0 else "no rows"
        except Exception as error:  # noqa: BLE001 - reported, and the others go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {key} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed; without SQL: {sorted(set(QUERIES) - set(ORACLES))}; orphans: {sorted(set(ORACLES) - set(QUERIES))}")
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
