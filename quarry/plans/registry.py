"""How queries are registered, and the common form of their results: doubles rounded, whole numbers as long."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.windows import rounded

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return keep


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as long."""
    form = {"double": lambda c: rounded(F.col(f"`{c}`"), digits), "float": lambda c: rounded(F.col(f"`{c}`").cast("double"), digits), "int": lambda c: F.col(f"`{c}`").cast("long")}
    return df.select(*((form[t](c) if t in form else F.col(f"`{c}`")).alias(c) for c, t in df.dtypes))


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """The SQL of a rounded double; adding 0 makes minus zero plain."""
    return f"round(cast({expression} as double), {digits}) + 0.0 as {name or expression}"
