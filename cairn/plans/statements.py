"""Each query as SQL that Spark and DuckDB both run; PS stands for the derived part-supplier table."""

PS = (
    'ps as (select l_partkey as ps_partkey, l_suppkey as ps_suppkey, min(l_extendedprice/l_quantity) as ps_supplycost, sum(l_quantity) as ps_availqty '
    'from lineitem group by l_partkey, l_suppkey)'
)

SQL = {
    "scan_project": """
        select n_nationkey, n_name from nation
    """,
    "filter_comparisons": """
        select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 5 and l_quantity >= 10 and l_quantity <
        45 and l_quantity <= 40 and l_linenumber <> 3 and l_returnflag = 'R'
    """,
    "filter_or_of_and": """
        select o_orderkey from orders where (o_orderstatus = 'F' and o_totalprice < 50000) or o_orderpriority = '1-URGENT' or
        (o_orderstatus = 'P' and o_totalprice > 450000)
    """,
    "filter_in": """
        select p_partkey, p_size, p_type from part where p_size in (49, 14, 23, 45, 19, 3, 36, 9) and p_type in ('PROMO',
        'SMALL')
    """,
    "filter_not_in_list": """
        select p_partkey from part where p_type not in ('PROMO', 'SMALL')
    """,
    "filter_like": """
        select p_partkey, p_name from part where p_name like 'blue%' or p_name like '%gear' or p_name like '%o%l%'
    """,
    "filter_not_like": """
        select p_partkey from part where p_name not like '%ring%'
    """,
    "filter_column_vs_column": """
        select l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate
    """,
    "project_arith": """
        select l_orderkey, l_linenumber, l_extendedprice*(1-l_discount) as disc_price,
        l_extendedprice*(1-l_discount)*(1+l_tax) as charge, l_extendedprice/l_quantity as unit_price, l_linenumber+1 as nxt,
        l_linenumber-1 as prv from lineitem where l_orderkey < 100
    """,
    "case_when": """
        select p_partkey, case when p_size < 10 then 'S' when p_size < 30 then 'M' else 'L' end as bucket from part
    """,
    "extract_year": """
        select o_orderkey, extract(year from o_orderdate) as o_year from orders
    """,
    "sub_string": """
        select c_custkey, substring(c_mktsegment, 1, 2) as seg2 from customer
    """,
    "agg_ungrouped": """
        select sum(l_quantity) as s, min(l_extendedprice) as mn, max(l_extendedprice) as mx, avg(l_quantity) as a, count(*) as
        c from lineitem
    """,
    "agg_group_single_key": """
        select o_custkey, count(*) as c, sum(o_totalprice) as s, min(o_totalprice) as mn, max(o_totalprice) as mx,
        avg(o_totalprice) as a from orders group by o_custkey
    """,
    "agg_group_multi_key": """
        select l_returnflag, l_linestatus, sum(l_quantity) as s, avg(l_extendedprice) as a, count(*) as c from lineitem group
        by l_returnflag, l_linestatus
    """,
    "agg_count_col_vs_star": """
        select c_custkey, count(o_orderkey) as c_col, count(*) as c_star from customer left join orders on c_custkey =
        o_custkey and o_orderdate >= date '2001-01-01' group by c_custkey
    """,
    "agg_post_expr": """
        select 100.0*sum(case when p_type like 'PROMO%' then l_extendedprice*(1-l_discount) else 0
        end)/sum(l_extendedprice*(1-l_discount)) as promo_revenue from lineitem, part where l_partkey = p_partkey
    """,
    "agg_having": """
        select l_orderkey, sum(l_quantity) as q from lineitem group by l_orderkey having sum(l_quantity) > 300
    """,
    "agg_count_distinct": """
        select l_returnflag, count(distinct l_suppkey) as c from lineitem group by l_returnflag
    """,
    "agg_minmax_string": """
        select min(p_name) as mn, max(p_name) as mx from part
    """,
    "select_distinct": """
        select distinct l_returnflag, l_linestatus from lineitem
    """,
    "join_inner": """
        select o_orderkey, c_name from orders join customer on o_custkey = c_custkey
    """,
    "join_inner_multikey": """
        select count(*) as c from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber =
        b.l_linenumber
    """,
    "join_left": """
        select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_orderdate >= date
        '2001-01-01'
    """,
    "join_right": """
        select c_custkey, o_orderkey from (select * from orders where o_orderdate >= date '2001-01-01') o right join customer
        on c_custkey = o_custkey
    """,
    "join_full": """
        select s_suppkey, n_nationkey from (select * from supplier where s_nationkey < 20) s full join (select * from nation
        where n_nationkey > 5) n on s_nationkey = n_nationkey
    """,
    "join_semi": """
        select o_orderkey from orders where exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment =
        'BUILDING')
    """,
    "join_anti": """
        select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >=
        date '2001-01-01')
    """,
    "join_semi_theta": """
        select l_orderkey, l_linenumber, l_suppkey from lineitem l1 where exists (select 1 from lineitem l2 where
        l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
    """,
    "join_anti_theta": """
        select l_orderkey, l_linenumber, l_suppkey from lineitem l1 where not exists (select 1 from lineitem l2 where
        l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
    """,
    "join_nlj_lt": """
        select a.n_nationkey as x, r_regionkey as y from nation a join region on a.n_nationkey < r_regionkey
    """,
    "join_nlj_ge_ne": """
        select a.n_nationkey as x, b.n_nationkey as y from nation a join nation b on a.n_nationkey >= b.n_regionkey and
        a.n_regionkey <> b.n_regionkey
    """,
    "cross_product": """
        select n_nationkey, r_regionkey from nation, region
    """,
    "join_float_2dp": """
        select a.p_partkey as x, b.p_partkey as y from part a join part b on round(a.p_retailprice, 2) =
        round(b.p_retailprice, 2) and a.p_partkey < b.p_partkey
    """,
    "order_multi_key": """
        select o_orderkey, o_totalprice, o_orderdate from orders order by o_totalprice desc, o_orderdate, o_orderkey
    """,
    "limit_offset": """
        select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 5
    """,
    "subquery_scalar_eq": """
        select c_custkey, c_acctbal from customer where c_acctbal = (select max(c_acctbal) from customer)
    """,
    "subquery_scalar_cmp": """
        select c_custkey from customer where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0)
    """,
    "subquery_in": """
        select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')
    """,
    "subquery_correlated": """
        select l_orderkey, l_linenumber from lineitem l where l_quantity < (select 0.2*avg(l_quantity) from lineitem i where
        i.l_partkey = l.l_partkey)
    """,
    "derived_table_alias": """
        select t.r_max, t.nk from (select max(a.s_acctbal) as r_max, a.s_nationkey as nk from supplier a, supplier b where
        a.s_suppkey = b.s_suppkey group by a.s_nationkey) as t
    """,
    "cte": """
        with big as (select o_custkey as k, sum(o_totalprice) as t from orders group by o_custkey) select c_custkey, t from
        customer, big where c_custkey = k and t > 3000000
    """,
    "values_list": """
        select * from (values (1, 'a'), (2, 'b')) as v(id, s)
    """,
    "tpch_q1": """
        select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice) as sum_base_price,
        sum(l_extendedprice*(1-l_discount)) as sum_disc_price, sum(l_extendedprice*(1-l_discount)*(1+l_tax)) as sum_charge,
        avg(l_quantity) as avg_qty, avg(l_extendedprice) as avg_price, avg(l_discount) as avg_disc, count(*) as count_order
        from lineitem where l_shipdate <= date '1997-10-01' group by l_returnflag, l_linestatus order by l_returnflag,
        l_linestatus
    """,
    "tpch_q2": """
        with PS select s_acctbal, s_name, n_name, p_partkey from part, supplier, ps, nation, region where p_partkey =
        ps_partkey and s_suppkey = ps_suppkey and p_size = 25 and p_type like '%PROMO' and s_nationkey = n_nationkey and
        n_regionkey = r_regionkey and r_name = 'ASIA' and ps_supplycost = (select min(ps_supplycost) from ps, supplier,
        nation, region where p_partkey = ps_partkey and s_suppkey = ps_suppkey and s_nationkey = n_nationkey and n_regionkey =
        r_regionkey and r_name = 'ASIA')
    """,
    "tpch_q3": """
        select l_orderkey, o_orderdate, sum(l_extendedprice*(1-l_discount)) as revenue from customer, orders, lineitem where
        c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < date '1996-03-15'
        and l_shipdate > date '1996-03-15' group by l_orderkey, o_orderdate
    """,
    "tpch_q4": """
        select o_orderpriority, count(*) as order_count from orders where o_orderdate >= date '1996-07-01' and o_orderdate <
        date '1996-10-01' and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate < o_orderdate) group
        by o_orderpriority
    """,
    "tpch_q5": """
        select n_name, sum(l_extendedprice*(1-l_discount)) as revenue from customer, orders, lineitem, supplier, nation,
        region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey
        and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' and o_orderdate >= date '1996-01-01'
        and o_orderdate < date '1997-01-01' group by n_name
    """,
    "tpch_q6": """
        select sum(l_extendedprice*l_discount) as revenue from lineitem where l_shipdate >= date '1996-01-01' and l_shipdate <
        date '1997-01-01' and l_discount >= 0.03 and l_discount <= 0.05 and l_quantity < 24
    """,
    "tpch_q7": """
        select supp_nation, cust_nation, l_year, sum(volume) as revenue from (select n1.n_name as supp_nation, n2.n_name as
        cust_nation, extract(year from l_shipdate) as l_year, l_extendedprice*(1-l_discount) as volume from supplier,
        lineitem, orders, customer, nation n1, nation n2 where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey
        = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey and ((n1.n_name = 'NATION_6' and
        n2.n_name = 'NATION_7') or (n1.n_name = 'NATION_7' and n2.n_name = 'NATION_6')) and l_shipdate >= date '1995-01-01'
        and l_shipdate <= date '1999-12-31') shipping group by supp_nation, cust_nation, l_year
    """,
    "tpch_q8": """
        select o_year, sum(case when nation = 'NATION_2' then volume else 0 end)/sum(volume) as mkt_share from (select
        extract(year from o_orderdate) as o_year, l_extendedprice*(1-l_discount) as volume, n2.n_name as nation from part,
        lineitem, supplier, orders, customer, nation n1, nation n2, region where p_partkey = l_partkey and s_suppkey =
        l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey and n1.n_regionkey =
        r_regionkey and r_name = 'AMERICA' and s_nationkey = n2.n_nationkey and o_orderdate >= date '1995-01-01' and
        o_orderdate <= date '1996-12-31' and p_type = 'ECONOMY') all_nations group by o_year
    """,
    "tpch_q9": """
        with PS select n_name as nation, extract(year from o_orderdate) as o_year, sum(l_extendedprice*(1-l_discount) -
        ps_supplycost*l_quantity) as sum_profit from part, supplier, lineitem, ps, orders, nation where s_suppkey = l_suppkey
        and ps_suppkey = l_suppkey and ps_partkey = l_partkey and p_partkey = l_partkey and o_orderkey = l_orderkey and
        s_nationkey = n_nationkey and p_name like '%gear%' group by n_name, extract(year from o_orderdate)
    """,
    "tpch_q10": """
        select c_custkey, c_name, c_acctbal, n_name, sum(l_extendedprice*(1-l_discount)) as revenue from customer, orders,
        lineitem, nation where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= date '1996-10-01' and
        o_orderdate < date '1997-01-01' and l_returnflag = 'R' and c_nationkey = n_nationkey group by c_custkey, c_name,
        c_acctbal, n_name
    """,
    "tpch_q11": """
        with PS select ps_partkey, sum(ps_supplycost*ps_availqty) as value from ps, supplier, nation where ps_suppkey =
        s_suppkey and s_nationkey = n_nationkey and n_name = 'NATION_7' group by ps_partkey having
        sum(ps_supplycost*ps_availqty) > (select sum(ps_supplycost*ps_availqty)*0.0001 from ps, supplier, nation where
        ps_suppkey = s_suppkey and s_nationkey = n_nationkey and n_name = 'NATION_7')
    """,
    "tpch_q12": """
        select l_linestatus, sum(case when o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' then 1 else 0 end) as
        high_line_count, sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end) as
        low_line_count from orders, lineitem where o_orderkey = l_orderkey and l_returnflag in ('A', 'R') and o_orderdate <
        l_shipdate and l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01' group by l_linestatus
    """,
    "tpch_q13": """
        select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left join
        orders on c_custkey = o_custkey and o_orderpriority not like '%NOT%SPECIFIED%' group by c_custkey) c_orders group by
        c_count
    """,
    "tpch_q14": """
        select 100.0*sum(case when p_type like 'PROMO%' then l_extendedprice*(1-l_discount) else 0
        end)/sum(l_extendedprice*(1-l_discount)) as promo_revenue from lineitem, part where l_partkey = p_partkey and
        l_shipdate >= date '1995-09-01' and l_shipdate < date '1995-10-01'
    """,
    "tpch_q15": """
        with revenue as (select l_suppkey as supplier_no, sum(round(l_extendedprice*(1-l_discount), 2)) as total_revenue from
        lineitem where l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-04-01' group by l_suppkey) select
        s_suppkey, s_name, round(total_revenue, 2) as total_revenue from supplier, revenue where s_suppkey = supplier_no and
        round(total_revenue, 2) = (select max(round(total_revenue, 2)) from revenue)
    """,
    "tpch_q16": """
        with PS select p_brand, p_type, p_size, count(distinct ps_suppkey) as supplier_cnt from ps, part where p_partkey =
        ps_partkey and p_brand <> 'Brand#12' and p_type not like 'MEDIUM%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9) and
        ps_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by p_brand, p_type, p_size
    """,
    "tpch_q17": """
        select sum(l_extendedprice)/7.0 as avg_yearly from lineitem, part where p_partkey = l_partkey and p_brand = 'Brand#12'
        and p_type = 'PROMO' and l_quantity < (select 0.5*avg(l_quantity) from lineitem where l_partkey = p_partkey)
    """,
    "tpch_q18": """
        select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) as q from customer, orders, lineitem
        where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 250) and c_custkey =
        o_custkey and o_orderkey = l_orderkey group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
    """,
    "tpch_q19": """
        select sum(l_extendedprice*(1-l_discount)) as revenue from lineitem, part where (p_partkey = l_partkey and p_brand =
        'Brand#12' and p_type in ('SMALL', 'PROMO') and l_quantity >= 1 and l_quantity <= 11 and p_size >= 1 and p_size <= 15)
        or (p_partkey = l_partkey and p_brand = 'Brand#13' and p_type in ('MEDIUM', 'ECONOMY') and l_quantity >= 10 and
        l_quantity <= 20 and p_size >= 1 and p_size <= 30) or (p_partkey = l_partkey and p_brand = 'Brand#14' and p_type in
        ('LARGE', 'STANDARD') and l_quantity >= 20 and l_quantity <= 30 and p_size >= 1 and p_size <= 45)
    """,
    "tpch_q20": """
        with PS select s_name from supplier, nation where s_suppkey in (select ps_suppkey from ps where ps_partkey in (select
        p_partkey from part where p_name like 'blue%') and ps_availqty > (select 0.5*sum(l_quantity) from lineitem where
        l_partkey = ps_partkey and l_suppkey = ps_suppkey and l_shipdate >= date '1996-01-01' and l_shipdate < date
        '1997-01-01')) and s_nationkey = n_nationkey and n_name = 'NATION_3'
    """,
    "tpch_q21": """
        select s_name, count(*) as numwait from supplier, lineitem l1, orders, nation where s_suppkey = l1.l_suppkey and
        o_orderkey = l1.l_orderkey and o_orderstatus = 'F' and l1.l_shipdate > o_orderdate and exists (select 1 from lineitem
        l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey) and not exists (select 1 from lineitem l3
        where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_quantity > 45) and s_nationkey =
        n_nationkey and n_name = 'NATION_20' group by s_name
    """,
    "tpch_q22": """
        select cntrycode, count(*) as numcust, sum(c_acctbal) as totacctbal from (select substring(c_mktsegment, 1, 2) as
        cntrycode, c_acctbal from customer where substring(c_mktsegment, 1, 2) in ('BU', 'MA', 'FU') and c_acctbal > (select
        avg(c_acctbal) from customer where c_acctbal > 0.00 and substring(c_mktsegment, 1, 2) in ('BU', 'MA', 'FU')) and not
        exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= date '2000-01-01')) custsale group by
        cntrycode
    """,
}


def text(name: str) -> str:
    """The statement of a query."""
    return " ".join(SQL[name].replace("with PS ", f"with {PS} ").split())
