"""One query for each operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract_year, in_list, like, llm, not_like, sub_string
from ..operators import (
    aggregate,
    anti_join,
    filter_rows,
    hash_join,
    limit,
    nested_loop_join,
    order_by,
    project,
    radix_join,
    replicated_join,
    semi_join,
    tiled_join,
)
from .registry import query
from .statements import text

c = F.col


def late(t):
    return filter_rows(t.orders, c("o_orderdate") >= F.to_timestamp_ntz(F.lit("2001-01-01 00:00:00")))


@query("scan_project")
def scan_project(t):
    return project(t.nation, "n_nationkey", "n_name")


@query("filter_comparisons")
def filter_comparisons(t):
    q = c("l_quantity")
    return filter_rows(t.lineitem, q > 5, q >= 10, q < 45, q <= 40, c("l_linenumber") != 3, c("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_or_of_and")
def filter_or_of_and(t):
    status, price = c("o_orderstatus"), c("o_totalprice")
    return filter_rows(t.orders, ((status == "F") & (price < 50000)) | (c("o_orderpriority") == "1-URGENT") | ((status == "P") & (price > 450000))).select("o_orderkey")


@query("filter_in")
def filter_in(t):
    return filter_rows(t.part, in_list("p_size", (49, 14, 23, 45, 19, 3, 36, 9)), in_list("p_type", ("PROMO", "SMALL"))).select("p_partkey", "p_size", "p_type")


@query("filter_not_in_list")
def filter_not_in_list(t):
    return filter_rows(t.part, ~in_list("p_type", ("PROMO", "SMALL"))).select("p_partkey")


@query("filter_like")
def filter_like(t):
    return filter_rows(t.part, like("p_name", "blue%") | like("p_name", "%gear") | like("p_name", "%o%l%")).select("p_partkey", "p_name")


@query("filter_not_like")
def filter_not_like(t):
    return filter_rows(t.part, not_like("p_name", "%ring%")).select("p_partkey")


@query("filter_column_vs_column")
def filter_column_vs_column(t):
    joined = hash_join(t.lineitem, t.orders, [("l_orderkey", "o_orderkey")])
    return filter_rows(joined, c("l_shipdate") < c("o_orderdate")).select("l_orderkey", "l_linenumber")


@query("project_arith")
def project_arith(t):
    price = c("l_extendedprice") * (1 - c("l_discount"))
    rows = filter_rows(t.lineitem, c("l_orderkey") < 100)
    return project(rows, "l_orderkey", "l_linenumber", disc_price=price, charge=price * (1 + c("l_tax")), unit_price=c("l_extendedprice") / c("l_quantity"), nxt=c("l_linenumber") + 1, prv=c("l_linenumber") - 1)


@query("case_when")
def case_when(t):
    return project(t.part, "p_partkey", bucket=F.when(c("p_size") < 10, "S").when(c("p_size") < 30, "M").otherwise("L"))


@query("extract_year")
def extract_year_(t):
    return project(t.orders, "o_orderkey", o_year=extract_year("o_orderdate"))


@query("sub_string")
def sub_string_(t):
    return project(t.customer, "c_custkey", seg2=sub_string("c_mktsegment", 0, 2))


@query("agg_ungrouped", rounded={"s": 2, "a": 6})
def agg_ungrouped(t):
    return aggregate(t.lineitem, s=F.sum("l_quantity"), mn=F.min("l_extendedprice"), mx=F.max("l_extendedprice"), a=F.avg("l_quantity"), c=F.count("*"))


@query("agg_group_single_key", rounded={"s": 2, "a": 7})
def agg_group_single_key(t):
    price = "o_totalprice"
    return aggregate(t.orders, ["o_custkey"], c=F.count("*"), s=F.sum(price), mn=F.min(price), mx=F.max(price), a=F.avg(price))


@query("agg_group_multi_key", rounded={"s": 2, "a": 4})
def agg_group_multi_key(t):
    return aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], s=F.sum("l_quantity"), a=F.avg("l_extendedprice"), c=F.count("*"))


@query("agg_count_col_vs_star")
def agg_count_col_vs_star(t):
    return aggregate(hash_join(t.customer, late(t), [("c_custkey", "o_custkey")], "left"), ["c_custkey"], c_col=F.count("o_orderkey"), c_star=F.count("*"))


@query("agg_post_expr", rounded={"promo_revenue": 6})
def agg_post_expr(t):
    price = c("l_extendedprice") * (1 - c("l_discount"))
    joined = hash_join(t.lineitem, t.part, [("l_partkey", "p_partkey")])
    return aggregate(joined, promo_revenue=100.0 * F.sum(F.when(like("p_type", "PROMO%"), price).otherwise(0)) / F.sum(price))


@query("agg_having", rounded={"q": 2})
def agg_having(t):
    return aggregate(t.lineitem, ["l_orderkey"], having=c("q") > 300, q=F.sum("l_quantity"))


@query("agg_count_distinct")
def agg_count_distinct(t):
    return aggregate(t.lineitem, ["l_returnflag"], c=F.count_distinct("l_suppkey"))


@query("agg_minmax_string")
def agg_minmax_string(t):
    return aggregate(t.part, mn=F.min("p_name"), mx=F.max("p_name"))


@query("select_distinct")
def select_distinct(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("join_inner")
def join_inner(t):
    return hash_join(t.orders, t.customer, [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


@query("join_inner_multikey")
def join_inner_multikey(t):
    a, b = t.lineitem.select("l_orderkey", "l_linenumber"), t.lineitem.select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"))
    return aggregate(hash_join(a, b, [("l_orderkey", "k"), ("l_linenumber", "n")]), c=F.count("*"))


@query("join_left")
def join_left(t):
    return hash_join(t.customer, late(t), [("c_custkey", "o_custkey")], "left").select("c_custkey", "o_orderkey")


@query("join_right")
def join_right(t):
    return hash_join(late(t), t.customer, [("o_custkey", "c_custkey")], "right").select("c_custkey", "o_orderkey")


@query("join_full")
def join_full(t):
    return hash_join(filter_rows(t.supplier, c("s_nationkey") < 20), filter_rows(t.nation, c("n_nationkey") > 5), [("s_nationkey", "n_nationkey")], "full").select("s_suppkey", "n_nationkey")


@query("join_semi")
def join_semi(t):
    return semi_join(t.orders, filter_rows(t.customer, c("c_mktsegment") == "BUILDING"), [("o_custkey", "c_custkey")]).select("o_orderkey")


@query("join_anti")
def join_anti(t):
    return anti_join(t.customer, late(t), [("c_custkey", "o_custkey")]).select("c_custkey")


@query("join_semi_theta")
def join_semi_theta(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    return semi_join(rows, t.lineitem, [("l_orderkey", "l_orderkey")], [("l_suppkey", "<>", "l_suppkey")])


@query("join_anti_theta")
def join_anti_theta(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    return anti_join(rows, t.lineitem, [("l_orderkey", "l_orderkey")], [("l_suppkey", "<>", "l_suppkey")])


@query("join_nlj_lt")
def join_nlj_lt(t):
    return nested_loop_join(t.nation, t.region, [("n_nationkey", "<", "r_regionkey")]).select(c("n_nationkey").alias("x"), c("r_regionkey").alias("y"))


@query("join_nlj_ge_ne")
def join_nlj_ge_ne(t):
    a, b = t.nation.select(c("n_nationkey").alias("x"), c("n_regionkey").alias("xr")), t.nation.select(c("n_nationkey").alias("y"), c("n_regionkey").alias("yr"))
    return nested_loop_join(a, b, [("x", ">=", "yr"), ("xr", "<>", "yr")]).select("x", "y")


@query("cross_product")
def cross_product(t):
    return t.nation.select("n_nationkey").crossJoin(t.region.select("r_regionkey"))


@query("join_float_2dp")
def join_float_2dp(t):
    a, b = (t.part.select(c("p_partkey").alias(k), F.round("p_retailprice", 2).alias(p)) for k, p in (("x", "px"), ("y", "py")))
    return tiled_join(a, b, [("px", "py")], [("x", "<", "y")]).select("x", "y")


@query("order_multi_key")
def order_multi_key(t):
    return order_by(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate"), ("o_totalprice", "desc"), "o_orderdate", "o_orderkey")


@query("limit_offset")
def limit_offset(t):
    return limit(order_by(t.orders.select("o_orderkey", "o_totalprice"), ("o_totalprice", "desc"), "o_orderkey"), 10, 5)


@query("subquery_scalar_eq")
def subquery_scalar_eq(t):
    return t.customer.filter(c("c_acctbal") == t.customer.agg(F.max("c_acctbal")).scalar()).select("c_custkey", "c_acctbal")


@query("subquery_scalar_cmp")
def subquery_scalar_cmp(t):
    return t.customer.filter(c("c_acctbal") > t.customer.filter("c_acctbal > 0").agg(F.avg("c_acctbal")).scalar()).select("c_custkey")


@query("subquery_in")
def subquery_in(t):
    return semi_join(t.orders, filter_rows(t.customer, c("c_mktsegment") == "MACHINERY"), [("o_custkey", "c_custkey")]).select("o_orderkey")


@query("subquery_correlated")
def subquery_correlated(t):
    mean = aggregate(t.lineitem, [c("l_partkey").alias("k")], least=0.2 * F.avg("l_quantity"))
    return filter_rows(hash_join(t.lineitem, mean, [("l_partkey", "k")]), c("l_quantity") < c("least")).select("l_orderkey", "l_linenumber")


@query("derived_table_alias")
def derived_table_alias(t):
    a, b = t.supplier.select("s_suppkey", "s_acctbal", "s_nationkey"), t.supplier.select(c("s_suppkey").alias("k"))
    return aggregate(hash_join(a, b, [("s_suppkey", "k")]), [c("s_nationkey").alias("nk")], r_max=F.max("s_acctbal")).select("r_max", "nk")


@query("cte", rounded={"t": 2})
def cte(t):
    big = aggregate(t.orders, [c("o_custkey").alias("k")], having=c("t") > 3000000, t=F.sum("o_totalprice"))
    return hash_join(t.customer.select("c_custkey"), big, [("c_custkey", "k")]).select("c_custkey", "t")


@query("values_list")
def values_list(t):
    return t.spark.sql("select * from values (1, 'a'), (2, 'b') as v(id, s)")


@query("first_last", sql="select l_orderkey, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship from lineitem group by l_orderkey")
def first_last(t):
    ship = "l_shipdate"
    return aggregate(t.lineitem, ["l_orderkey"], first_ship=F.min_by(ship, ship), last_ship=F.max_by(ship, ship))


@query("llm_prompt", sql="select p_partkey, 'describe: ' || coalesce(p_name, '') as answer from part")
def llm_prompt(t):
    return project(t.part, "p_partkey", answer=llm("describe: ", "p_name"))


@query("radix_join", sql=text("join_inner"))
def radix_join_(t):
    return radix_join(t.orders, t.customer, ("o_custkey", "c_custkey")).select("o_orderkey", "c_name")


@query("broadcast_join", sql=text("join_inner"))
def broadcast_join(t):
    return replicated_join(t.orders, t.customer, [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")
