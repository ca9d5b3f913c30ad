"""Queries for predicates on nulls, casts, simple CASE, ALL, theta joins that keep rows, grouping sets, time and range joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import all_of, int_divide
from ..operators import aggregate, asof_join, filter_rows, hash_join, limit, nested_loop_join, order_by, project, range_join
from .registry import query

c = F.col


def with_orders(t):
    """Customers with their orders of over 300,000; nulls for customers without any."""
    return hash_join(t.customer, filter_rows(t.orders, c("o_totalprice") > 300000), [("c_custkey", "o_custkey")], "left")


WITH_ORDERS = "customer left join (select * from orders where o_totalprice > 300000) o on c_custkey = o_custkey"


@query("is_null", sql=f"select c_custkey from {WITH_ORDERS} where o_orderkey is null")
def is_null(t):
    return filter_rows(with_orders(t), c("o_orderkey").isNull()).select("c_custkey")


@query("is_not_null", sql=f"select c_custkey, o_orderkey from {WITH_ORDERS} where o_orderkey is not null")
def is_not_null(t):
    return filter_rows(with_orders(t), c("o_orderkey").isNotNull()).select("c_custkey", "o_orderkey")


@query("between", sql="select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 12")
def between(t):
    return filter_rows(t.lineitem, c("l_quantity").between(10, 12)).select("l_orderkey", "l_linenumber")


@query("cast", sql="select o_orderkey, cast(substring(o_orderpriority, 1, 1) as integer) as priority, cast(o_orderkey as varchar) as name, cast(o_custkey as double) as customer from orders")
def cast(t):
    return project(t.orders, "o_orderkey", priority=F.substring("o_orderpriority", 1, 1).cast("int"), name=c("o_orderkey").cast("string"), customer=c("o_custkey").cast("double"))


@query("coalesce", sql=f"select c_custkey, coalesce(o_orderkey, -1) as o_orderkey from {WITH_ORDERS}")
def coalesce(t):
    return project(with_orders(t), "c_custkey", o_orderkey=F.coalesce("o_orderkey", F.lit(-1)))


@query("nullif", sql="select o_orderkey, nullif(o_orderstatus, 'F') as status from orders")
def nullif(t):
    return project(t.orders, "o_orderkey", status=F.nullif("o_orderstatus", F.lit("F")))


@query("distinct_from", sql=f"select c_custkey from {WITH_ORDERS} where o_orderstatus is distinct from 'F'")
def distinct_from(t):
    return filter_rows(with_orders(t), ~c("o_orderstatus").eqNullSafe("F")).select("c_custkey")


@query("case_simple", sql="select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end as code from orders")
def case_simple(t):
    status = c("o_orderstatus")
    return project(t.orders, "o_orderkey", code=F.when(status == "F", 1).when(status == "O", 2).otherwise(0))


@query("int_divide", sql="select l_orderkey, l_linenumber, l_partkey // 7 as q, (l_orderkey + 9007199254740993) // 1 as large from lineitem")
def int_divide_(t):
    return project(t.lineitem, "l_orderkey", "l_linenumber", q=int_divide("l_partkey", F.lit(7)), large=int_divide(c("l_orderkey") + F.lit(9007199254740993), F.lit(1)))


@query("op_all", sql="select p_partkey from part where p_size >= all (select p_size from part where p_size < 45) and p_size < all (select p_size from part where p_size > 1000)")
def op_all(t):
    few = filter_rows(t.part, c("p_size") < 45).select("p_size")
    none = filter_rows(t.part, c("p_size") > 1000).select("p_size")
    return filter_rows(t.part, all_of("p_size", ">=", few), all_of("p_size", "<", none)).select("p_partkey")


def _nulls(t, way):
    rows = aggregate(with_orders(t), ["c_custkey"], top=F.max("o_totalprice"))
    return limit(order_by(rows, ("top", "desc"), "c_custkey", nulls=way), 40)


_NULLS = f"select c_custkey, max(o_totalprice) as top from {WITH_ORDERS} group by c_custkey order by top desc nulls %s, c_custkey limit 40"


@query("order_nulls_first", sql=_NULLS % "first")
def order_nulls_first(t):
    return _nulls(t, "first")


@query("order_nulls_last", sql=_NULLS % "last")
def order_nulls_last(t):
    return _nulls(t, "last")


def _theta(t, how):
    return nested_loop_join(t.nation.select(c("n_nationkey").alias("x")), t.region.select(c("r_regionkey").alias("y")), [("x", "<", "y")], how)


@query("join_nlj_left", sql="select n_nationkey as x, r_regionkey as y from nation left join region on n_nationkey < r_regionkey")
def join_nlj_left(t):
    return _theta(t, "left")


@query("join_nlj_right", sql="select n_nationkey as x, r_regionkey as y from nation right join region on n_nationkey < r_regionkey")
def join_nlj_right(t):
    return _theta(t, "right")


@query("join_nlj_semi", sql="select n_nationkey as x from nation where exists (select * from region where n_nationkey < r_regionkey)")
def join_nlj_semi(t):
    return _theta(t, "left_semi")


@query("join_nlj_anti", sql="select n_nationkey as x from nation where not exists (select * from region where n_nationkey < r_regionkey)")
def join_nlj_anti(t):
    return _theta(t, "left_anti")


_GROUPED = "select o_orderstatus, o_orderpriority, count(*) as n from orders group by %s"


@query("group_rollup", longs=("n",), sql=_GROUPED % "rollup (o_orderstatus, o_orderpriority)")
def group_rollup(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("group_cube", longs=("n",), sql=_GROUPED % "cube (o_orderstatus, o_orderpriority)")
def group_cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("group_sets", longs=("n",), sql=_GROUPED % "grouping sets ((o_orderstatus), (o_orderpriority), ())")
def group_sets(t):
    sets = [[c("o_orderstatus")], [c("o_orderpriority")], []]
    return t.orders.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("asof_join", sql="select event_id, (select max(o_orderdate) from orders where o_custkey = user_id and o_orderdate <= ts) as o_orderdate from events")
def asof_join_(t):
    return asof_join(t.events.select("event_id", "user_id", "ts"), t.orders, [("user_id", "o_custkey")], ("ts", "o_orderdate"), ["o_orderdate"]).select("event_id", "o_orderdate")


@query("range_join", sql="select p_partkey, s_suppkey from part join supplier on p_retailprice between s_acctbal and s_acctbal + 50")
def range_join_(t):
    span = project(t.supplier, "s_suppkey", low=c("s_acctbal"), high=c("s_acctbal") + 50)
    return range_join(t.part, span, "p_retailprice", "low", "high", 50).select("p_partkey", "s_suppkey")
