"""SQL statements over a database: CREATE TABLE, DROP TABLE, INSERT and COPY change it, queries read it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaMismatch, StatementError
from ..functions import register, register_function
from ..sources import Database, show, write_csv
from ..types import spark_type

_CREATE = re.compile(r"\s*create\s+table\s+(\w+)\s*\((.*)\)\s*;?\s*\Z", re.I | re.S)
_DROP = re.compile(r"\s*drop\s+table\s+(\w+)\s*;?\s*\Z", re.I)
_INSERT = re.compile(r"\s*insert\s+into\s+(\w+)\s+((?:select|values|with|\().*)\Z", re.I | re.S)
_COPY = re.compile(r"\s*copy\s+(\w+)\s+(from|to)\s+'([^']+)'\s*;?\s*\Z", re.I)


@dataclass
class QueryResult:
    """A statement's rows, not yet computed; none for definitions."""

    df: DataFrame | None

    def row_count(self) -> int:
        return 0 if self.df is None else self.df.count()

    def show(self, n: int = 20, tail: bool = False) -> str:
        return "" if self.df is None else show(self.df, n, tail)


class QueryHandler:
    """Runs one statement at a time against a database's tables, all of Spark's SELECT language included.

    Each handler has a session of its own, with the settings of the database's, in which its tables are known by name;
    so handlers of several databases, and the caller's own views, don't get in each other's way.
    """

    def __init__(self, db: Database):
        self.spark = db.spark.newSession()
        for key, value in db.spark.conf.getAll.items():
            if self.spark.conf.isModifiable(key):
                self.spark.conf.set(key, value)
        self.db = Database(self.spark, db.folder, create=False)
        register(self.spark)

    def register(self, name: str, function: Callable[..., Column]) -> None:
        """Make a function of scalar_function() known to statements by name."""
        register_function(self.spark, name, function)

    def _select(self, sql: str) -> DataFrame:
        """The rows of one query; StatementError for any other statement, and for what can't be parsed or resolved."""
        sql = sql.strip().rstrip(";")
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
            while plan.getClass().getSimpleName() == "UnresolvedWith":
                plan = plan.child()
            of = self.spark._jvm.java.lang.Class.forName
            kinds = ("Command", "ParsedStatement")
            if any(of(f"org.apache.spark.sql.catalyst.plans.logical.{k}").isInstance(plan) for k in kinds):
                raise StatementError(f"not a query: {plan.getClass().getSimpleName()}")
            tables = self.db.tables()
            for view in self.spark.catalog.listTables():
                if view.isTemporary and view.name not in (t.lower() for t in tables):
                    self.spark.catalog.dropTempView(view.name)
            for name in tables:
                self.db.table(name).createOrReplaceTempView(name)
            return self.spark.sql(sql)
        except (ParseException, AnalysisException) as e:
            raise StatementError(str(e).split("\n")[0]) from None

    def query(self, sql: str) -> QueryResult:
        """StatementError for what can't be parsed or resolved, TableExists and NoSuchTable as the database says."""
        if made := _CREATE.match(sql):
            name, columns, key = made[1], [], []
            for part in re.split(r",(?![^()]*\))", made[2]):
                if keys := re.match(r"\s*primary\s+key\s*\(([^)]*)\)\s*\Z", part, re.I):
                    key += [k.strip() for k in keys[1].split(",")]
                    continue
                column = re.match(r"\s*(\w+)\s+(\w+(?:\s*\(\s*\d+\s*\))?)(\s+primary\s+key)?\s*\Z", part, re.I)
                if not column:
                    raise StatementError(f"can't read {part.strip()!r}")
                try:
                    columns.append(T.StructField(column[1], spark_type(column[2])))
                except ValueError as e:
                    raise StatementError(str(e)) from None
                key += [column[1]] if column[3] else []
            if unknown := set(key) - {c.name for c in columns}:
                raise StatementError(f"no columns {sorted(unknown)}")
            self.db.register(name, T.StructType(columns), key)
            return QueryResult(None)
        if dropped := _DROP.match(sql):
            self.db.drop(dropped[1])
            return QueryResult(None)
        if put := _INSERT.match(sql):
            schema, rows = self.db.schema(put[1]), self._select(put[2])
            if len(rows.columns) != len(schema):
                raise SchemaMismatch(f"{put[1]} has {len(schema)} columns, not {len(rows.columns)}")
            self.db.insert(put[1], rows.toDF(*schema.names).select(*(F.col(f.name).cast(f.dataType) for f in schema)))
            return QueryResult(None)
        if copied := _COPY.match(sql):
            if copied[2].lower() == "from":
                self.db.load_files(copied[1], copied[3])
            else:
                write_csv(self.db.table(copied[1]), copied[3])
            return QueryResult(None)
        return QueryResult(self._select(sql))
