"""Row-for-row comparison of a Spark result with SQL run by DuckDB."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value + 0.0:.9g}"
    if isinstance(value, Decimal):
        return f"dec:{value}"
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return f"{type(value).__name__}:{value}"


def table_of(names: list[str], rows: list) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def from_spark(df) -> tuple[list[str], list[tuple[str, ...]]]:
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def from_sql(con, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    result = con.execute(sql)
    return table_of([d[0] for d in result.description], result.fetchall())


def difference(spark_side, sql_side) -> str | None:
    """None when equal, else a short account of the first difference."""
    if spark_side[0] != sql_side[0]:
        return f"columns {spark_side[0]} against {sql_side[0]}"
    if len(spark_side[1]) != len(sql_side[1]):
        return f"{len(spark_side[1])} rows against {len(sql_side[1])}"
    for ours, theirs in zip(spark_side[1], sql_side[1]):
        if ours != theirs:
            return f"{ours} against {theirs}"
    return None
