"""Queries that go through the SQL front door or a database instead of DataFrame code."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar_function
from ..operators import same_rows
from ..sources import Database, write_csv
from ..sql import QueryHandler
from . import tpch  # noqa: F401  its queries' forms are needed here
from .registry import FORMS, QUERIES, query
from .statements import SQL, text

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: The folder of the database loaded from each folder of tables, by application.
_loaded: dict[tuple[str, str], str] = {}


def scratch(t, name: str) -> str:
    """A new folder name below the one that driver and executors share."""
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"


def loaded(t) -> QueryHandler:
    """A handler of a database that all tables were inserted into, opened again."""
    at = (t.spark.sparkContext.applicationId, t._folder)
    if at not in _loaded:
        db = Database(t.spark, scratch(t, "db"))
        for table in TABLES:
            db.register(table, getattr(t, table).schema)
            db.insert(table, getattr(t, table))
        _loaded[at] = db.folder
    return QueryHandler(Database(t.spark, _loaded[at], create=False))


#: The same statements as text: the SQL path must give what DataFrame code gives.
for _n in range(1, 23):
    _name = f"tpch_q{_n}"
    query(f"sql_{_name}", *FORMS[_name], sql=text(_name))(lambda t, statement=text(_name): loaded(t).query(statement).df)


@query("database_reopen", sql="select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def database_reopen(t):
    """Rows inserted into a database's table, read back after the database is opened again."""
    return loaded(t).query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier").df


def _as_text(t, name: str, columns: tuple[str, ...], files: int) -> str:
    """A table's columns as delimited text files; the folder."""
    folder = scratch(t, "text")
    getattr(t, name).select(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)).alias("value")).repartition(files).write.text(folder)
    return folder


def _load(t, files: int):
    db = Database(t.spark, scratch(t, "db"))
    q = QueryHandler(db)
    q.query("create table nation (n_nationkey int, n_name varchar(25), n_regionkey int, primary key (n_nationkey))")
    q.query(f"copy nation from '{_as_text(t, 'nation', ('n_nationkey', 'n_name', 'n_regionkey'), files)}'")
    return QueryHandler(Database(t.spark, db.folder, create=False)).query("select n_regionkey, count(*) as n, min(n_name) as first_name from nation group by n_regionkey").df


_LOADED = "select n_regionkey, count(*) as n, min(n_name) as first_name from nation group by n_regionkey"


@query("text_load", longs=("n",), sql=_LOADED)
def text_load(t):
    """One delimited text file, loaded into a table made by CREATE TABLE, queried after the database is opened again."""
    return _load(t, 1)


@query("text_load_files", longs=("n",), sql=_LOADED)
def text_load_files(t):
    """The same rows from several files."""
    return _load(t, 4)


@query("sql_insert", sql="select r_regionkey as id, r_name as name from region union all select 100, 'NOWHERE'")
def sql_insert(t):
    q = QueryHandler(Database(t.spark, scratch(t, "db")))
    q.query("create table region (id int, name string)")
    q.db.insert("region", t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    q.query("insert into region values (100, 'NOWHERE')")
    return q.query("select id, name from region").df


@query("sql_create_drop", sql="select * from (values ('made', 'a'), ('made', 'b'), ('left', 'b')) as v(step, name)")
def sql_create_drop(t):
    """Tables after two are made, and after one of them is dropped."""
    q = QueryHandler(Database(t.spark, scratch(t, "db")))
    q.query("create table a (id int)")
    q.query("create table b (id int primary key, score double)")
    made = [("made", name) for name in q.db.tables()]
    q.query("drop table a")
    return t.spark.createDataFrame(made + [("left", name) for name in q.db.tables()], "step string, name string")


@query("csv_export", sql="select n_nationkey, n_name, n_regionkey from nation")
def csv_export(t):
    """A table written as CSV with a header and read back."""
    folder = scratch(t, "csv")
    write_csv(t.nation, folder)
    return t.spark.read.csv(folder, header=True, schema=t.nation.schema).select("n_nationkey", "n_name", "n_regionkey")


@query("user_function", sql="select p_partkey, p_size * 2 + 7 as made from part where p_size * 2 + 7 > 40")
def user_function(t):
    """A user's batch function, its constants bound once, called by name in SQL."""
    q = loaded(t)
    q.register("scaled", scalar_function(lambda data, x: x * data[0] + data[1], "int", bind=lambda *c: c, constants=(2, 7)))
    return q.query("select p_partkey, scaled(p_size) as made from part where scaled(p_size) > 40").df


@query("results_equal", sql="select true as itself, true as doubled_only, true as less_one")
def results_equal(t):
    """Rows are told to be the same in any order, and not so if one is missing or stands twice."""
    rows = t.supplier.select("s_suppkey", "s_acctbal")
    told = (same_rows(rows, rows.orderBy("s_acctbal"), 2), not same_rows(rows, rows.union(rows.limit(1))), not same_rows(rows, rows.filter("s_suppkey > 1")))
    return t.spark.createDataFrame([told], "itself boolean, doubled_only boolean, less_one boolean")


__all__ = ["QUERIES", "SQL"]
