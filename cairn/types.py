"""Logical types: the names that table definitions use and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Names in definitions, and the spellings that CREATE TABLE takes for them.
LOGICAL = {
    "INTEGER": (T.IntegerType(), ("int", "integer", "int4")),
    "FLOAT": (T.FloatType(), ("float", "real", "float4")),
    "DOUBLE": (T.DoubleType(), ("double", "float8")),
    "STRING": (T.StringType(), ("string", "varchar", "text")),
    "BOOL": (T.BooleanType(), ("bool", "boolean")),
    "LONG": (T.LongType(), ("bigint", "int8")),
    "DATE": (T.DateType(), ("date",)),
    "TIMESTAMP": (T.TimestampNTZType(), ("timestamp", "timestamp_ntz")),
}
_BY_SPELLING = {s: t for t, spellings in LOGICAL.values() for s in spellings} | {name.lower(): t for name, (t, _) in LOGICAL.items()}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a logical name or a CREATE TABLE spelling (varchar(20) too); ValueError if unknown."""
    found = _BY_SPELLING.get(name.strip().lower().split("(")[0].strip())
    if found is None:
        raise ValueError(f"unknown type {name!r}")
    return found


def schema(*columns: tuple[str, str]) -> T.StructType:
    """A schema of (name, type name) pairs, all nullable."""
    return T.StructType([T.StructField(name, spark_type(kind)) for name, kind in columns])
