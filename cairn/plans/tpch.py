"""The 22 TPC-H queries on the tables at hand; constants and stand-in columns are those of statements.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract_year, in_list, like, not_like, sub_string
from ..operators import aggregate, anti_join, filter_rows, hash_join, order_by, replicated_join, semi_join
from .registry import query

c = F.col


def price():
    """What a line item costs."""
    return c("l_extendedprice") * (1 - c("l_discount"))


def day(text):
    return F.to_timestamp_ntz(F.lit(f"{text} 00:00:00"))


def partsupp(t):
    """A part-supplier table from the line items."""
    line = t.lineitem
    return aggregate(
        line, [c("l_partkey").alias("ps_partkey"), c("l_suppkey").alias("ps_suppkey")], ps_supplycost=F.min(c("l_extendedprice") / c("l_quantity")), ps_availqty=F.sum("l_quantity")
    )


def in_region(t, name):
    """Nations of a region; small dimensions are replicated where their size allows."""
    return replicated_join(t.nation, filter_rows(t.region, c("r_name") == name), [("n_regionkey", "r_regionkey")]).select("n_nationkey", "n_name")


@query("tpch_q1", rounded=dict(sum_qty=2, sum_base_price=2, sum_disc_price=2, sum_charge=2, avg_qty=6, avg_price=4, avg_disc=8))
def q1(t):
    rows = filter_rows(t.lineitem, c("l_shipdate") <= day("1997-10-01"))
    out = aggregate(
        rows, ["l_returnflag", "l_linestatus"], sum_qty=F.sum("l_quantity"), sum_base_price=F.sum("l_extendedprice"), sum_disc_price=F.sum(price()),
        sum_charge=F.sum(price() * (1 + c("l_tax"))), avg_qty=F.avg("l_quantity"), avg_price=F.avg("l_extendedprice"), avg_disc=F.avg("l_discount"), count_order=F.count("*"),
    )
    return order_by(out, "l_returnflag", "l_linestatus")


@query("tpch_q2")
def q2(t):
    suppliers = replicated_join(t.supplier, in_region(t, "ASIA"), [("s_nationkey", "n_nationkey")])
    parts = filter_rows(t.part, c("p_size") == 25, like("p_type", "%PROMO")).select("p_partkey")
    offers = hash_join(semi_join(partsupp(t), parts, [("ps_partkey", "p_partkey")]), suppliers, [("ps_suppkey", "s_suppkey")])
    # the least cost comes from the same rows, as a window over each part's few offers
    from pyspark.sql import Window

    ranked = offers.withColumn("least", F.min("ps_supplycost").over(Window.partitionBy("ps_partkey")))
    return filter_rows(ranked, c("ps_supplycost") == c("least")).select("s_acctbal", "s_name", "n_name", c("ps_partkey").alias("p_partkey"))


@query("tpch_q3", rounded={"revenue": 2})
def q3(t):
    buyers = filter_rows(t.customer, c("c_mktsegment") == "BUILDING")
    orders = semi_join(filter_rows(t.orders, c("o_orderdate") < day("1996-03-15")), buyers, [("o_custkey", "c_custkey")]).select("o_orderkey", "o_orderdate")
    lines = filter_rows(t.lineitem, c("l_shipdate") > day("1996-03-15"))
    return aggregate(hash_join(lines, orders, [("l_orderkey", "o_orderkey")]), ["l_orderkey", "o_orderdate"], revenue=F.sum(price()))


@query("tpch_q4")
def q4(t):
    orders = filter_rows(t.orders, c("o_orderdate") >= day("1996-07-01"), c("o_orderdate") < day("1996-10-01"))
    early = semi_join(orders, t.lineitem, [("o_orderkey", "l_orderkey")], [("o_orderdate", ">", "l_shipdate")])
    return aggregate(early, ["o_orderpriority"], order_count=F.count("*"))


@query("tpch_q5", rounded={"revenue": 2})
def q5(t):
    nations = in_region(t, "ASIA")
    orders = filter_rows(t.orders, c("o_orderdate") >= day("1996-01-01"), c("o_orderdate") < day("1997-01-01"))
    sold = hash_join(t.lineitem, hash_join(orders, t.customer, [("o_custkey", "c_custkey")]), [("l_orderkey", "o_orderkey")])
    local = hash_join(sold, replicated_join(t.supplier, nations, [("s_nationkey", "n_nationkey")]), [("l_suppkey", "s_suppkey"), ("c_nationkey", "s_nationkey")])
    return aggregate(local, ["n_name"], revenue=F.sum(price()))


@query("tpch_q6", rounded={"revenue": 2})
def q6(t):
    ship, discount = c("l_shipdate"), c("l_discount")
    rows = filter_rows(t.lineitem, ship >= day("1996-01-01"), ship < day("1997-01-01"), discount >= 0.03, discount <= 0.05, c("l_quantity") < 24)
    return aggregate(rows, revenue=F.sum(c("l_extendedprice") * discount))


@query("tpch_q7", rounded={"revenue": 2})
def q7(t):
    pair = filter_rows(t.nation, in_list("n_name", ("NATION_6", "NATION_7")))
    sellers = replicated_join(t.supplier, pair.select(c("n_nationkey").alias("sn"), c("n_name").alias("supp_nation")), [("s_nationkey", "sn")])
    buyers = replicated_join(t.customer, pair.select(c("n_nationkey").alias("cn"), c("n_name").alias("cust_nation")), [("c_nationkey", "cn")])
    lines = filter_rows(t.lineitem, c("l_shipdate") >= day("1995-01-01"), c("l_shipdate") <= day("1999-12-31"))
    sold = hash_join(hash_join(lines, sellers, [("l_suppkey", "s_suppkey")]), hash_join(t.orders, buyers, [("o_custkey", "c_custkey")]), [("l_orderkey", "o_orderkey")])
    return aggregate(filter_rows(sold, c("supp_nation") != c("cust_nation")), ["supp_nation", "cust_nation", extract_year("l_shipdate").alias("l_year")], revenue=F.sum(price()))


@query("tpch_q8", rounded={"mkt_share": 8})
def q8(t):
    orders = filter_rows(t.orders, c("o_orderdate") >= day("1995-01-01"), c("o_orderdate") <= day("1996-12-31"))
    buyers = semi_join(t.customer, in_region(t, "AMERICA"), [("c_nationkey", "n_nationkey")])
    lines = semi_join(t.lineitem, filter_rows(t.part, c("p_type") == "ECONOMY"), [("l_partkey", "p_partkey")])
    sold = hash_join(lines, semi_join(orders, buyers, [("o_custkey", "c_custkey")]), [("l_orderkey", "o_orderkey")])
    sold = hash_join(sold, replicated_join(t.supplier, t.nation, [("s_nationkey", "n_nationkey")]), [("l_suppkey", "s_suppkey")])
    return aggregate(sold, [extract_year("o_orderdate").alias("o_year")], mkt_share=F.sum(F.when(c("n_name") == "NATION_2", price()).otherwise(0)) / F.sum(price()))


@query("tpch_q9", rounded={"sum_profit": 2})
def q9(t):
    parts = filter_rows(t.part, like("p_name", "%gear%")).select("p_partkey")
    lines = semi_join(t.lineitem, parts, [("l_partkey", "p_partkey")])
    costs = semi_join(partsupp(t), parts, [("ps_partkey", "p_partkey")])
    sold = hash_join(lines, costs, [("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey")])
    sold = hash_join(hash_join(sold, t.orders, [("l_orderkey", "o_orderkey")]), replicated_join(t.supplier, t.nation, [("s_nationkey", "n_nationkey")]), [("l_suppkey", "s_suppkey")])
    return aggregate(sold, [c("n_name").alias("nation"), extract_year("o_orderdate").alias("o_year")], sum_profit=F.sum(price() - c("ps_supplycost") * c("l_quantity")))


@query("tpch_q10", rounded={"revenue": 2})
def q10(t):
    orders = filter_rows(t.orders, c("o_orderdate") >= day("1996-10-01"), c("o_orderdate") < day("1997-01-01"))
    lines = hash_join(filter_rows(t.lineitem, c("l_returnflag") == "R"), orders, [("l_orderkey", "o_orderkey")])
    # revenue is summed by customer before the customer's own columns are joined
    spent = aggregate(lines, ["o_custkey"], revenue=F.sum(price()))
    buyers = replicated_join(t.customer, t.nation, [("c_nationkey", "n_nationkey")])
    return hash_join(buyers, spent, [("c_custkey", "o_custkey")]).select("c_custkey", "c_name", "c_acctbal", "n_name", "revenue")


@query("tpch_q11", rounded={"value": 2})
def q11(t):
    sellers = replicated_join(t.supplier, filter_rows(t.nation, c("n_name") == "NATION_7"), [("s_nationkey", "n_nationkey")])
    stock = semi_join(partsupp(t), sellers, [("ps_suppkey", "s_suppkey")]).withColumn("v", c("ps_supplycost") * c("ps_availqty"))
    return aggregate(stock, ["ps_partkey"], having=c("value") > aggregate(stock, x=F.sum("v") * 0.0001).scalar(), value=F.sum("v"))


@query("tpch_q12", longs=("high_line_count", "low_line_count"))
def q12(t):
    ship = c("l_shipdate")
    lines = filter_rows(t.lineitem, in_list("l_returnflag", ("A", "R")), ship >= day("1996-01-01"), ship < day("1997-01-01"))
    joined = filter_rows(hash_join(lines, t.orders, [("l_orderkey", "o_orderkey")]), c("o_orderdate") < ship)
    high = in_list("o_orderpriority", ("1-URGENT", "2-HIGH"))
    return aggregate(joined, ["l_linestatus"], high_line_count=F.sum(F.when(high, 1).otherwise(0)), low_line_count=F.sum(F.when(~high, 1).otherwise(0)))


@query("tpch_q13")
def q13(t):
    orders = filter_rows(t.orders, not_like("o_orderpriority", "%NOT%SPECIFIED%"))
    # counted per customer before the join: at most one row a customer meets it
    counts = aggregate(orders, ["o_custkey"], n=F.count("o_orderkey"))
    each = hash_join(t.customer, counts, [("c_custkey", "o_custkey")], "left").select(F.coalesce("n", F.lit(0)).cast("bigint").alias("c_count"))
    return aggregate(each, ["c_count"], custdist=F.count("*"))


@query("tpch_q14", rounded={"promo_revenue": 6})
def q14(t):
    lines = filter_rows(t.lineitem, c("l_shipdate") >= day("1995-09-01"), c("l_shipdate") < day("1995-10-01"))
    joined = hash_join(lines, t.part, [("l_partkey", "p_partkey")])
    return aggregate(joined, promo_revenue=100.0 * F.sum(F.when(like("p_type", "PROMO%"), price()).otherwise(0)) / F.sum(price()))


@query("tpch_q15", rounded={"total_revenue": 2})
def q15(t):
    lines = filter_rows(t.lineitem, c("l_shipdate") >= day("1996-01-01"), c("l_shipdate") < day("1996-04-01"))
    revenue = aggregate(lines, ["l_suppkey"], total=F.sum(F.round(price(), 2))).select("l_suppkey", F.round("total", 2).alias("total_revenue"))
    best = filter_rows(revenue, c("total_revenue") == aggregate(revenue, m=F.max("total_revenue")).scalar())
    return hash_join(t.supplier, best, [("s_suppkey", "l_suppkey")]).select("s_suppkey", "s_name", "total_revenue")


@query("tpch_q16")
def q16(t):
    parts = filter_rows(t.part, c("p_brand") != "Brand#12", not_like("p_type", "MEDIUM%"), in_list("p_size", (49, 14, 23, 45, 19, 3, 36, 9)))
    pairs = anti_join(partsupp(t), filter_rows(t.supplier, c("s_acctbal") < 0), [("ps_suppkey", "s_suppkey")])
    return aggregate(hash_join(pairs, parts, [("ps_partkey", "p_partkey")]), ["p_brand", "p_type", "p_size"], supplier_cnt=F.count_distinct("ps_suppkey"))


@query("tpch_q17", rounded={"avg_yearly": 2})
def q17(t):
    parts = filter_rows(t.part, c("p_brand") == "Brand#12", c("p_type") == "PROMO").select("p_partkey")
    lines = semi_join(t.lineitem, parts, [("l_partkey", "p_partkey")])
    mean = aggregate(lines, [c("l_partkey").alias("k")], most=0.5 * F.avg("l_quantity"))
    return aggregate(filter_rows(hash_join(lines, mean, [("l_partkey", "k")]), c("l_quantity") < c("most")), avg_yearly=F.sum("l_extendedprice") / 7.0)


@query("tpch_q18", rounded={"q": 2})
def q18(t):
    # an order's quantity is its lines' sum: one aggregate serves the condition and the result
    large = aggregate(t.lineitem, ["l_orderkey"], having=c("q") > 250, q=F.sum("l_quantity"))
    orders = hash_join(t.orders, large, [("o_orderkey", "l_orderkey")])
    return hash_join(orders, t.customer, [("o_custkey", "c_custkey")]).select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "q")


@query("tpch_q19", rounded={"revenue": 2})
def q19(t):
    joined = hash_join(t.lineitem, t.part, [("l_partkey", "p_partkey")])
    quantity, size = c("l_quantity"), c("p_size")

    def branch(brand, types, low, most):
        return (c("p_brand") == brand) & in_list("p_type", types) & quantity.between(low, low + 10) & size.between(1, most)

    wanted = branch("Brand#12", ("SMALL", "PROMO"), 1, 15) | branch("Brand#13", ("MEDIUM", "ECONOMY"), 10, 30) | branch("Brand#14", ("LARGE", "STANDARD"), 20, 45)
    return aggregate(filter_rows(joined, wanted), revenue=F.sum(price()))


@query("tpch_q20")
def q20(t):
    lines = filter_rows(t.lineitem, c("l_shipdate") >= day("1996-01-01"), c("l_shipdate") < day("1997-01-01"))
    shipped = aggregate(lines, ["l_partkey", "l_suppkey"], half=0.5 * F.sum("l_quantity"))
    stock = semi_join(partsupp(t), filter_rows(t.part, like("p_name", "blue%")), [("ps_partkey", "p_partkey")])
    enough = filter_rows(hash_join(stock, shipped, [("ps_partkey", "l_partkey"), ("ps_suppkey", "l_suppkey")]), c("ps_availqty") > c("half"))
    sellers = replicated_join(t.supplier, filter_rows(t.nation, c("n_name") == "NATION_3"), [("s_nationkey", "n_nationkey")])
    return semi_join(sellers, enough, [("s_suppkey", "ps_suppkey")]).select("s_name")


@query("tpch_q21")
def q21(t):
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate")
    waiting = filter_rows(hash_join(lines, filter_rows(t.orders, c("o_orderstatus") == "F"), [("l_orderkey", "o_orderkey")]), c("l_shipdate") > c("o_orderdate"))
    sellers = replicated_join(t.supplier, filter_rows(t.nation, c("n_name") == "NATION_20"), [("s_nationkey", "n_nationkey")])
    own = hash_join(waiting, sellers, [("l_suppkey", "s_suppkey")]).select("l_orderkey", "l_suppkey", "s_name")
    other = [("l_suppkey", "<>", "l_suppkey")]
    shared = semi_join(own, t.lineitem, [("l_orderkey", "l_orderkey")], other)
    alone = anti_join(shared, filter_rows(t.lineitem, c("l_quantity") > 45), [("l_orderkey", "l_orderkey")], other)
    return aggregate(alone, ["s_name"], numwait=F.count("*"))


@query("tpch_q22", rounded={"totacctbal": 2})
def q22(t):
    code = sub_string("c_mktsegment", 0, 2)
    buyers = filter_rows(t.customer.withColumn("cntrycode", code), in_list("cntrycode", ("BU", "MA", "FU")))
    rich = filter_rows(buyers, c("c_acctbal") > aggregate(filter_rows(buyers, c("c_acctbal") > 0), m=F.avg("c_acctbal")).scalar())
    idle = anti_join(rich, filter_rows(t.orders, c("o_orderdate") >= day("2000-01-01")), [("c_custkey", "o_custkey")])
    return aggregate(idle, ["cntrycode"], numcust=F.count("*"), totacctbal=F.sum("c_acctbal"))
