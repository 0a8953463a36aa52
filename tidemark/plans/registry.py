"""Queries over the library's operators, bound to the standard tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Added before numbers are rounded, on both sides: engines differ in how they round a decimal that ends in 5.
NUDGE = 1.234e-8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its own name, with the SQL that states its result, if SQL can; its roundings get the nudge."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("round(", f"round({NUDGE}::DOUBLE + ")
        return f

    return add


def rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """df with numbers rounded for comparison."""
    return df.withColumns({c: F.round(F.col(c) + NUDGE, digits) for c in names})


def load() -> None:
    """Imports all modules that register queries."""
    from tidemark.plans import archive, details, filings, markets, ranking, streams, texts  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that the smoke check runs."""
    return queries()["x15_rank"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries."""
    load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    """All registered SQL statements."""
    load()
    return ORACLE
