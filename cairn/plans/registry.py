"""Where queries are registered: a name, DataFrame code, and SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from .statements import SQL, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: What a query's results are rounded to, by name, and its counts; see query().
FORMS: dict[str, tuple[dict[str, int], tuple[str, ...]]] = {}


class Tables:
    """A folder's tables by name: t.lineitem reads the columns that the query goes on to use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return scan(self.spark, f"{self._folder}/{name}.parquet")


def query(name: str, rounded: dict[str, int] | None = None, longs: tuple[str, ...] = (), sql: str | None = None):
    """Register a function of Tables. rounded: places of sums and means of decimals, whose last digits depend on
    the order of addition; longs: counts that SQL dialects give other integer types. Both apply to either side.
    """
    rounded = rounded or {}
    FORMS[name] = (rounded, longs)

    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = f(Tables(spark, folder))
            return out.withColumns({c: F.round(c, n) for c, n in rounded.items()} | {c: F.col(c).cast("bigint") for c in longs})

        statement = sql or (text(name) if name in SQL else None)
        if statement:
            changes = [f"round({c}, {n}) as {c}" for c, n in rounded.items()] + [f"cast({c} as bigint) as {c}" for c in longs]
            ORACLE_SQL[name] = f"select * replace ({', '.join(changes)}) from ({statement}) q" if changes else statement
        QUERIES[name] = run
        return f

    return add
