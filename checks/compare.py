"""Run queries next to their SQL twins and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    rows = df.select(*[f"`{n}`" for n in names]).collect()
    return names, Counter(tuple(_plain(v) for v in row) for row in rows)


def duckdb_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    return [names[i] for i in order], rows


KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def type_differences(
    df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str
) -> list[str]:
    """Columns whose types differ between a query and its twin."""
    theirs = {row[0]: str(row[1]) for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    ours = {name: KINDS.get(kind, kind) for name, kind in df.dtypes}
    return [f"{n}: {ours[n]} against {theirs.get(n)}" for n in ours if ours[n] != theirs.get(n)]


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a query and its twin; empty when they agree."""
    ours, theirs = spark_rows(df), duckdb_rows(connection, sql)
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} against {theirs[0]}"]
    missing, extra = theirs[1] - ours[1], ours[1] - theirs[1]
    report = [f"only in SQL: {row}" for row in list(missing)[:3]]
    return report + [f"only in Spark: {row}" for row in list(extra)[:3]]
