"""Delimited text in, CSV out, and tables on the console."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidData


def read_text(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, separator: str = "|") -> DataFrame:
    """Rows of delimited text without a header; several files are read in parallel. White space is kept.

    A wrong number of fields or a value that isn't of its column's type ends the query that reads it with
    InvalidData's message; the check is part of the scan.
    """
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    raw = lines.select(F.split("value", re.escape(separator), -1).alias("f"))
    # a trailing separator gives one more, empty, field
    n = len(schema)
    wrong = ~((F.size("f") == n) | ((F.size("f") == n + 1) & (F.get("f", F.lit(n)) == "")))
    row_error = F.raise_error(F.lit("wrong number of fields"))
    columns = []
    for i, field in enumerate(schema):
        text = F.when(wrong, row_error).otherwise(F.get("f", F.lit(i)))
        if isinstance(field.dataType, T.StringType):
            columns.append(text.alias(field.name))
        else:
            value = text.try_cast(field.dataType)
            error = F.raise_error(F.concat(F.lit(f"bad value for {field.name}: "), F.get("f", F.lit(i))))
            columns.append(F.when(value.isNull(), error).otherwise(value).cast(field.dataType).alias(field.name))
    return raw.select(*columns)


def checked(action, *args, **kwargs):
    """Run an action; what read_text found wrong becomes InvalidData."""
    try:
        return action(*args, **kwargs)
    except Exception as e:
        text = str(e)
        for sign in ("wrong number of fields", "bad value for"):
            if sign in text:
                raise InvalidData(text[text.index(sign) :].split("\n")[0][:200]) from None
        raise


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """df as CSV part files with a header."""
    df.write.mode(mode).csv(path, header=True)


def show(df: DataFrame, n: int = 20, tail: bool = False) -> str:
    """The first n rows (or the last) as a text table, which is also printed."""
    rows = df.tail(n) if tail else df.take(n)
    cells = [df.columns, *([("NULL" if x is None else str(x)) for x in r] for r in rows)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    lines = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)) + " |" for r in cells]
    out = "\n".join([rule, lines[0], rule, *lines[1:], rule])
    print(out)
    return out
