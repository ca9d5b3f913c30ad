"""Edge cases of the relational operators: nulls, empty sides, duplicates, theta conditions."""

import operator

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.operators import (
    aggregate,
    anti_join,
    collect,
    filter_rows,
    hash_join,
    limit,
    nested_loop_join,
    order_by,
    project,
    radix_join,
    replicated_join,
    scan,
    semi_join,
)
from cairn.operators.relational import COMPARE


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame([(1, 1.0), (None, 2.0), (0, 3.0), (None, None)], "k int, v double")


@pytest.fixture(scope="module")
def dups(spark):
    return spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k2 int, w int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "k2 int, w int")


def test_null_keys_match_nothing(keys, dups):
    assert rows(hash_join(keys, dups, [("k", "k2")]).select("k", "w")) == [(1, 1), (1, 2)]
    assert rows(hash_join(keys, dups, [("k", "k2")], "left").select("k", "v", "w")) == sorted([(1, 1.0, 1), (1, 1.0, 2), (None, 2.0, None), (0, 3.0, None), (None, None, None)], key=repr)
    assert rows(hash_join(keys, dups, [("k", "k2")], "full").select("k", "w")) == sorted([(1, 1), (1, 2), (None, None), (0, None), (None, None), (None, 3)], key=repr)


def test_semi_keeps_a_row_once(keys, dups):
    assert rows(semi_join(keys, dups, [("k", "k2")])) == [(1, 1.0)]


def test_empty_build(keys, nothing):
    assert len(rows(anti_join(keys, nothing, [("k", "k2")]))) == 4
    assert rows(semi_join(keys, nothing, [("k", "k2")])) == []
    assert {r[2] for r in rows(hash_join(keys, nothing, [("k", "k2")], "left").select("k", "v", "w"))} == {None}
    assert len(rows(anti_join(keys, nothing, [("k", "k2")], [("v", "<", "w")]))) == 4


def test_strict_less_in_semi_and_anti(keys, dups):
    assert rows(semi_join(keys, dups.filter("w = 1"), [("k", "k2")], [("v", "<", "w")])) == []
    assert rows(semi_join(keys, dups, [("k", "k2")], [("v", "<", "w")])) == [(1, 1.0)]
    assert len(rows(anti_join(keys, dups.filter("w = 1"), [("k", "k2")], [("v", "<", "w")]))) == 4


VALUES = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.integers(0, 3))), max_size=7)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=VALUES, right=VALUES, op=st.sampled_from(sorted(COMPARE)))
def test_semi_and_anti_against_brute_force(spark, left, right, op):
    a, b = spark.createDataFrame(left, "k int, x int"), spark.createDataFrame(right, "k2 int, y int")
    has = lambda k, x: any(k is not None and k == k2 and x is not None and y is not None and COMPARE[op](x, y) for k2, y in right)
    assert rows(semi_join(a, b, [("k", "k2")], [("x", op, "y")])) == sorted([r for r in left if has(*r)], key=repr)
    assert rows(anti_join(a, b, [("k", "k2")], [("x", op, "y")])) == sorted([r for r in left if not has(*r)], key=repr)


def test_two_comparisons(spark):
    a, b = spark.createDataFrame([(1, 5, 5)], "k int, x int, y int"), spark.createDataFrame([(1, 9, 1), (1, 1, 9)], "k2 int, p int, q int")
    assert rows(semi_join(a, b, [("k", "k2")], [("x", "<", "p"), ("y", "<", "q")])) == []  # no one row has both


def test_theta_join(spark, dups):
    a = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert rows(nested_loop_join(a, dups, [("x", "<", "w")]).select("x", "w")) == [(1, 2), (1, 3), (2, 3)]
    assert rows(nested_loop_join(a, dups, [("x", ">", "w")], "left_anti")) == sorted([(1,), (None,)], key=repr)


def test_radix_and_replicated_plans(spark, tiny):
    orders, customers = scan(spark, f"{tiny}/orders.parquet"), scan(spark, f"{tiny}/customer.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan(radix_join(orders, customers, ("o_custkey", "c_custkey")))
    assert "BroadcastHashJoin" in plan(replicated_join(orders, customers, [("o_custkey", "c_custkey")]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(replicated_join(orders, customers, [("o_custkey", "c_custkey")], most=10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pushdown_and_pruning(spark, tiny):
    df = filter_rows(scan(spark, f"{tiny}/lineitem.parquet"), F.col("l_quantity") > 40).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_aggregates_skip_nulls_and_keep_the_null_group(keys, nothing):
    assert rows(aggregate(keys, ["k"], s=F.sum("v"), n=F.count("v"), c=F.count("*"))) == sorted([(None, 2.0, 1, 2), (1, 1.0, 1, 1), (0, 3.0, 1, 1)], key=repr)
    assert rows(aggregate(nothing, s=F.sum("w"), m=F.min("w"), a=F.avg("w"), c=F.count("*"))) == [(None, None, None, 0)]
    assert rows(aggregate(keys, ["k"], having=F.col("c") > 1, c=F.count("*"))) == [(None, 2)]


def test_boolean_algebra(spark):
    a = spark.range(6)
    x = F.col("id")
    assert rows(filter_rows(a, (x == 1) | (x == 3) | (x == 5))) == [(1,), (3,), (5,)]
    assert rows(filter_rows(a, (x > 1) & ((x == 1) | (x == 2)))) == [(2,)]
    assert rows(filter_rows(a, ~(x > 1))) == [(0,), (1,)]


def test_case_takes_the_first_match(spark):
    got = project(spark.range(3), b=F.when(F.col("id") < 1, "a").when(F.col("id") < 2, "b").otherwise("c"))
    assert [r[0] for r in collect(got)] == ["a", "b", "c"]


def test_order_and_limit(keys):
    assert [r["v"] for r in order_by(keys, ("v", "desc")).collect()] == [3.0, 2.0, 1.0, None]
    assert [r["v"] for r in order_by(keys, "v", nulls="first").collect()] == [None, 1.0, 2.0, 3.0]
    assert [r["v"] for r in limit(order_by(keys, "v"), 2, 1).collect()] == [2.0, 3.0]
    assert "TakeOrderedAndProject" in limit(order_by(keys, "v"), 2)._jdf.queryExecution().executedPlan().toString()


def test_rounded_keys(spark):
    a, b = spark.createDataFrame([(1.001,), (1.006,)], "x double"), spark.createDataFrame([(1.004,)], "y double")
    assert rows(hash_join(a, b, [("x", "y")], places=2)) == [(1.001, 1.004)]
    assert operator.eq(rows(hash_join(a, b, [("x", "y")])), [])
