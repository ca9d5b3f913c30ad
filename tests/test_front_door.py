"""Handlers don't get in each other's way, refuse what isn't a query, and know users' functions; ALL, time and range joins by hand."""

import random

import pytest

from cairn.errors import NoSuchTable, SchemaMismatch, StatementError
from cairn.functions import all_of, int_divide, scalar_function
from cairn.operators import asof_join, range_join, same_rows
from cairn.sources import Database
from cairn.sql import QueryHandler


@pytest.fixture
def two(spark, tmp_path):
    out = []
    for i in range(2):
        q = QueryHandler(Database(spark, str(tmp_path / f"db{i}")))
        q.query("create table t1 (a int)")
        q.query(f"insert into t1 values ({i})")
        out.append(q)
    return out


def test_handlers_read_their_own_tables(spark, two):
    spark.range(3).createOrReplaceTempView("t1")
    try:
        assert [q.query("select a from t1").df.first().a for q in two] == [0, 1]
        assert spark.table("t1").count() == 3
        two[0].db.drop("t1")
        with pytest.raises(StatementError):
            two[0].query("select a from t1")
        assert two[1].query("with x as (select a from t1) select * from x").row_count() == 1
    finally:
        spark.catalog.dropTempView("t1")


def test_only_queries(two):
    q = two[0]
    for bad in ("create table zz as select 1 a", "drop view t1", "set spark.sql.shuffle.partitions=3", "insert overwrite t1 select 1", "from t1 insert into t2 select a", "cache table t1", "explain select 1", "truncate table t1"):
        with pytest.raises(StatementError):
            q.query(bad)
    assert q.db.tables() == ["t1"]


def test_insert_and_copy(spark, two, tmp_path):
    q = two[0]
    q.query("insert into t1 select a + 10 from t1")
    (tmp_path / "more.tbl").write_text("7\n8\n")
    q.query(f"copy t1 from '{tmp_path / 'more.tbl'}'")
    assert sorted(r.a for r in q.query("select a from t1").df.collect()) == [0, 7, 8, 10]
    q.query(f"copy t1 to '{tmp_path / 'out'}';")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 4
    with pytest.raises(NoSuchTable):
        q.query("insert into nope values (1)")
    with pytest.raises(SchemaMismatch):
        q.query("insert into t1 values (1, 2)")


def test_users_functions(two):
    two[0].register("shout", scalar_function(lambda s: s.astype(str) + "!", "string"))
    assert two[0].query("select shout(a) x from t1").df.first().x == "0!"
    with pytest.raises(StatementError):
        two[1].query("select shout(a) x from t1")


def test_int_divide(spark):
    df = spark.createDataFrame([(9007199254740993, 1), (-7, 2), (7, -2), (1, 0), (None, 1), (1, None)], "a bigint, b bigint")
    assert [r.q for r in df.select(int_divide("a", "b").alias("q")).collect()] == [9007199254740993, -3, -3, None, None, None]


@pytest.mark.parametrize("values", [[], [1, 3], [2, 2], [None], [1, None], [4, None]])
def test_all(spark, values):
    xs = [0, 1, 2, 3, 4, None]
    df, vs = spark.createDataFrame([(x,) for x in xs], "x int"), spark.createDataFrame([(v,) for v in values], "v int")
    holds = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    for op, f in holds.items():
        want = []
        for x in xs:
            each = [None if x is None or v is None else f(x, v) for v in values]
            want.append(False if False in each else None if None in each else True)
        assert [r.y for r in df.select(all_of("x", op, vs).alias("y")).collect()] == want


def test_asof_and_range_joins(spark):
    rnd = random.Random(1)
    left = [(i, rnd.choice([1, 2, None]), rnd.choice([*range(20), None])) for i in range(60)]
    right = [(rnd.choice([1, 2, 3, None]), rnd.choice([*range(20), None]), i) for i in range(30)]
    l, r = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k2 int, t2 int, v int")
    got = {x.id: (x.t, x.v) for x in asof_join(l, r, [("k", "k2")], ("t", "t2"), ["v"]).collect()}
    for i, k, t in left:
        fit = [(t2, v) for k2, t2, v in right if None not in (k, t, t2) and k2 == k and t2 <= t]
        assert got[i] == (t, max(fit)[1] if fit else None)
    spans = [(i, a := rnd.uniform(-50, 50), a + rnd.uniform(-5, 40)) for i in range(40)]
    points = [(i, rnd.uniform(-60, 60)) for i in range(50)] + [(99, None)]
    for width in (1.0, 17.0):
        pairs = range_join(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(spans, "s int, low double, high double"), "x", "low", "high", width)
        assert sorted((q.p, q.s) for q in pairs.collect()) == sorted((p, s) for p, x in points for s, a, b in spans if x is not None and a <= x <= b)


def test_same_rows(spark):
    a = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, None)], "x int, y double")
    assert same_rows(a, a.orderBy("y")) and not same_rows(a, a.distinct()) and not same_rows(a, a.withColumnRenamed("y", "z"))
    assert same_rows(a, a.withColumn("y", a.y + 1e-5), places=3) and not same_rows(a, a.withColumn("y", a.y + 1e-5))
