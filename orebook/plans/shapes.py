"""The domain's entities as shapes of the given tables, in Spark and in SQL.

Site: the region of a customer (or supplier). Order line: a line item with its order.
Item: the part. Required quantity: the quantity of lines not returned; returned lines are
stock at the supplier's site.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebook.operators.running import GroupSizes
from orebook.sources.tables import Tables

AS_OF = dt.date(1999, 6, 30)
SITES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDEAST")
HOLIDAYS = (dt.date(1996, 1, 1), dt.date(1997, 7, 4), dt.date(1998, 12, 25))
# Completes (order, line number), which is not unique, to a total order of lines.
LINE_TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


# Sixteen digits before the point, whatever the data of the day hold; quantities and prices have two after it.
QUANTITY, PRICE, MONEY = "decimal(18,2)", "decimal(18,2)", "decimal(18,2)"


def dec(c: str | Column, type_: str | None = None) -> Column:
    """An exact decimal: sums do not depend on the order of rows."""
    if type_ is None:
        type_ = QUANTITY if isinstance(c, str) and c == "l_quantity" else MONEY
    return (F.col(c) if isinstance(c, str) else c).cast(type_)


def dbl(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def site_name(c: str) -> Column:
    return F.replace(F.col(c), F.lit("MIDDLE EAST"), F.lit("MIDEAST"))


def add_site(t: Tables, df: DataFrame, nation_key: str) -> DataFrame:
    """The site of a nation key. Joined one small table at a time to the row side, so that each
    join is planned by the real size of its right side."""
    return (
        df.join(t.nation, F.col(nation_key) == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("site", site_name("r_name")).drop("n_regionkey", "r_regionkey", "r_name")
    )


def nation_sites(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", site_name("r_name").alias("site")
    )


def customer_sites(t: Tables) -> DataFrame:
    return add_site(t, t.customer, "c_nationkey")


def supplier_sites(t: Tables) -> DataFrame:
    return add_site(t, t.supplier, "s_nationkey")


def site_orders(t: Tables) -> DataFrame:
    """Orders with customer and site."""
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return add_site(t, orders, "c_nationkey").withColumn("order_date", F.to_date("o_orderdate"))


def site_lines(t: Tables) -> DataFrame:
    """Lines with their order. Customers meet the orders, which are fewer, first. Both sides grow
    with the data and neither is for broadcast; a merge join lets a hot order be split at run time."""
    return t.lineitem.hint("merge").join(site_orders(t), F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
        "promise_date", F.to_date("l_shipdate")
    )


def order_life(t: Tables) -> DataFrame:
    """Orders with site, order date and invoice date: the last shipment, none while open."""
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("last_ship"))
    orders = t.orders.hint("merge").join(shipped, "o_orderkey", "left").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    day = F.to_date("o_orderdate")
    return add_site(t, orders, "c_nationkey").select(
        "o_orderkey", "site", "o_orderstatus", "o_orderpriority", "o_totalprice", day.alias("order_date"),
        F.when(F.col("o_orderstatus") != "O", F.greatest(day, F.col("last_ship"))).alias("invoice_date"),
    )


def line_order(date: str = "promise_date") -> list[Column]:
    return [F.col(date).asc_nulls_last(), *[F.col(c) for c in LINE_TIES]]


def line_chunks(date: str = "promise_date") -> list[Column]:
    """Day, then ranges of order numbers: never falling along :func:`line_order`."""
    return [F.col(date), F.shiftright("l_orderkey", 20)]


def item_sizes(t) -> GroupSizes:
    """The busy items, counted once per query over the lines, as demand has no more rows per item than they have."""
    return vars(t).setdefault("item_sizes", GroupSizes(t.lineitem, ["l_partkey"]))


SQL_SITES = """ns as (
  select n_nationkey, n_name, replace(r_name, 'MIDDLE EAST', 'MIDEAST') as site
  from nation join region on n_regionkey = r_regionkey)"""
SQL_ORDERS = SQL_SITES + """, so as (
  select o.*, c.*, ns.*, cast(o_orderdate as date) as order_date
  from orders o join customer c on o_custkey = c_custkey join ns on c_nationkey = n_nationkey)"""
SQL_LINES = SQL_ORDERS + """, ln as (
  select l.*, so.*, cast(l_shipdate as date) as promise_date
  from lineitem l join so on l_orderkey = o_orderkey)"""
SQL_LIFE = SQL_ORDERS + """, life as (
  select o_orderkey, site, o_orderstatus, o_orderpriority, o_totalprice, order_date,
         case when o_orderstatus <> 'O' then greatest(order_date, last_ship) end as invoice_date
  from so left join (select l_orderkey, cast(max(l_shipdate) as date) as last_ship from lineitem group by 1) s
    on o_orderkey = l_orderkey)"""
SQL_LINE_ORDER = "promise_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
