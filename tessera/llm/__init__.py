"""Operators for preparing training text, and their named queries.

Each module holds one operator with its own interface; the thin ``opN_`` query at its end
applies it to a whole given table and derives the digest columns. Nothing outside this
subpackage imports it.
"""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MODULES = ("warc", "media", "line_dedup", "licenses", "decontaminate", "langid", "mixing", "jaccard", "html_text",
           "token_files", "whitening", "url_filter", "prefix_trie")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if given, the SQL that must return the same rows."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"tessera.llm.{module}")
