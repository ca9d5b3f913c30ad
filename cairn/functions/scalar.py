"""Scalar functions as Column expressions, so that they stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract_year(x: Column | str) -> Column:
    """The year of a date or timestamp, as a bigint."""
    return F.year(_column(x)).cast("bigint")


def dates_from_epoch(x: Column | str, zone: str = "UTC") -> Column:
    """The date on which an epoch second falls in a time zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_seconds(_column(x)).cast("timestamp_ntz")))


def sub_string(x: Column | str, start: int, length: int) -> Column:
    """length characters from start, which counts from 0; a start past the end gives an empty string."""
    if start < 0 or length < 0:
        raise ValueError("start and length count from 0")
    return F.substring(_column(x), start + 1, length)


def like(x: Column | str, pattern: str) -> Column:
    """SQL LIKE: % any run, _ any character, backslash escapes."""
    return _column(x).like(pattern)


def not_like(x: Column | str, pattern: str) -> Column:
    return ~like(x, pattern)


def in_list(x: Column | str, values: Iterable) -> Column:
    return _column(x).isin(list(values))


def int_divide(a: Column | str, b: Column | str) -> Column:
    """The quotient of integers, cut towards 0; null for a zero divisor."""
    a, b = _column(a), _column(b)
    return F.when(b != 0, F.call_function("div", a, b))


def near_equal(a: Column | str, b: Column | str, places: int = 2) -> Column:
    """Equality of decimals rounded to places; as a join condition it stays an equi-join on the rounded keys."""
    return F.round(_column(a), places) == F.round(_column(b), places)


def llm(prompt: str, a: Column | str, b: Column | str | None = None, backend: Callable[[list[str], list[str | None]], list[str | None]] | None = None) -> Column:
    """A prompt applied to a column; b is a second input for backends.

    Without a backend the result is the prompt followed by a (by nothing for null), a built-in expression that
    calls no service. A backend gets lists of the prompted texts and of b's values, batch by batch through Arrow,
    and gives as many results.
    """
    joined = F.concat(F.lit(prompt), F.coalesce(_column(a).cast("string"), F.lit("")))
    if backend is None:
        return joined

    @F.pandas_udf("string")
    def call(texts: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series(backend(texts.tolist(), others.tolist()))

    return call(joined, F.lit(None).cast("string") if b is None else _column(b).cast("string"))


def all_of(x: Column | str, op: str, values: DataFrame) -> Column:
    """x OP ALL (values), for the one column of values: true if there are none, null if only a null keeps it from being true.

    The values are reduced to a row of their extremes first, so that none but that row meets x.
    """
    x, v = _column(x), F.col(values.columns[0])
    bounds = values.agg(F.struct(F.count("*").alias("n"), F.count(v).alias("known"), F.min(v).alias("least"), F.max(v).alias("most")).alias("b")).scalar()
    holds = {
        "=": (x == bounds["least"]) & (x == bounds["most"]),
        "<": x < bounds["least"],
        "<=": x <= bounds["least"],
        ">": x > bounds["most"],
        ">=": x >= bounds["most"],
    }[op]
    return F.when(bounds["n"] == 0, True).when(bounds["known"] == 0, F.lit(None)).when(~holds, False).when(holds & (bounds["known"] == bounds["n"]), True)


def scalar_function(batch: Callable[..., pd.Series], returns: str, bind: Callable[..., object] | None = None, constants: tuple = ()) -> Callable[..., Column]:
    """A function of columns from one that works on batches: Arrow batches in, a batch of the type returns out.

    bind: turns the constants into data, once; batch then gets that data before its columns.
    """
    data = bind(*constants) if bind else None

    @F.pandas_udf(returns)
    def call(*columns: pd.Series) -> pd.Series:
        return batch(data, *columns) if bind else batch(*columns)

    return call


def register_function(spark: SparkSession, name: str, function: Callable[..., Column]) -> None:
    """Make what scalar_function gives known to SQL of this session by name."""
    spark.udf.register(name, function)


def register(spark: SparkSession) -> None:
    """Make llm(prompt, a, b) and sub_string(x, start, length) known to SQL of this session."""
    spark.sql("create or replace temporary function llm(prompt string, a string, b string) returns string return concat(prompt, coalesce(a, ''))")
    spark.sql("create or replace temporary function sub_string(x string, start int, length int) returns string return substring(x, start + 1, length)")
