"""The list of queries: a function per query and, where SQL can say it, the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SPLIT = " /* result */ "  # between the inputs of a query's SQL and its final SELECT


def query(name: str, sql: str | None = None, inputs: tuple[str, ...] = ()):
    """Register a query; ``inputs`` are the common table expressions its SQL starts with."""
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = (f"WITH RECURSIVE {', '.join(inputs)}{SPLIT}{sql}" if inputs else sql)
        return run
    return register


def rounded(df: DataFrame, digits: int = 9, *columns: str) -> DataFrame:
    """Round doubles, so that the order of summing does not show."""
    names = columns or [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def rnd(expression: str, digits: int = 9) -> str:
    """The same in SQL; adding 0 turns a negative zero into zero."""
    return f"(round({expression}, {digits}) + 0.0::DOUBLE)"
