"""Queries by name, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: What DuckDB's trim cuts off: spaces of all widths, but no tabs, carriage returns or other controls.
TRIMMED = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def tokens_sql(col: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({col}), '[^a-z0-9\s\-'']', ' ', 'g'), '\s+'), lambda x: length(x) > 1 AND length(x) < 40)"


def rounded_sql(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"
