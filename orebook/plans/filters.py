"""Filters and predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from orebook.plans.registry import query
from orebook.plans.shapes import AS_OF, SQL_LIFE, SQL_ORDERS, order_life, site_orders


@query("flt_not_blank", """
select doc_id, n_chars from documents where text is not null and trim(regexp_extract(text, '[0-9]+', 0)) <> ''""")
def flt_not_blank(t):
    found = F.regexp_extract("text", "[0-9]+", 0)
    return t.documents.filter(F.col("text").isNotNull() & (F.trim(found) != "")).select("doc_id", "n_chars")


@query("flt_case_insensitive", """
select c_custkey, c_mktsegment from customer where lower(c_mktsegment) <> 'building' and lower(c_name) like 'customer%'""")
def flt_case_insensitive(t):
    return t.customer.filter(
        (F.lower("c_mktsegment") != "building") & F.lower("c_name").startswith("customer")
    ).select("c_custkey", "c_mktsegment")


@query("flt_ilike", "select p_partkey, p_name from part where p_name ilike '%R%G%'")
def flt_ilike(t):
    return t.part.filter(F.col("p_name").ilike("%R%G%")).select("p_partkey", "p_name")


@query("flt_regex", "select p_partkey, p_brand from part where regexp_full_match(p_brand, 'Brand#(1|2)(,(1|2))*[0-9]?')")
def flt_regex(t):
    return t.part.filter(F.col("p_brand").rlike("^Brand#(1|2)(,(1|2))*[0-9]?$")).select("p_partkey", "p_brand")


@query("flt_distinct_from", f"""
with {SQL_LIFE} select o_orderkey, invoice_date from life where invoice_date is distinct from date '1998-12-18'""")
def flt_distinct_from(t):
    day = F.lit(dt.date(1998, 12, 18))
    return order_life(t).filter(~F.col("invoice_date").eqNullSafe(day)).select("o_orderkey", "invoice_date")


@query("flt_in_list", "select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '3-MEDIUM')")
def flt_in_list(t):
    return t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM")).select("o_orderkey", "o_orderpriority")


@query("flt_not_in_list", "select o_orderkey, o_orderstatus from orders where nullif(o_orderstatus, 'P') not in ('O')")
def flt_not_in_list(t):
    return t.orders.filter(~F.nullif(F.col("o_orderstatus"), F.lit("P")).isin("O")).select("o_orderkey", "o_orderstatus")


@query("flt_between_dates", """
select o_orderkey, cast(o_orderdate as date) as order_date from orders
where o_orderdate between timestamp '1996-01-01' and timestamp '1999-06-30'""")
def flt_between_dates(t):
    # Literals of the column's own type keep the comparison in the parquet scan.
    lo, hi = dt.datetime(1996, 1, 1), dt.datetime(1999, 6, 30)
    ntz = lambda x: F.lit(str(x)).cast("timestamp_ntz")
    return t.orders.filter(F.col("o_orderdate").between(ntz(lo), ntz(hi))).select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))


@query("flt_range_sanity", "select event_id, value from events where value * 60 > 0 and value * 60 < 10000")
def flt_range_sanity(t):
    s = F.col("value") * 60
    return t.events.filter((s > 0) & (s < 10000)).select("event_id", "value")


@query("flt_not_compound", """
select o_orderkey from orders where not (o_orderpriority = '1-URGENT' and nullif(o_orderstatus, 'P') = 'O')""")
def flt_not_compound(t):
    both = (F.col("o_orderpriority") == "1-URGENT") & (F.nullif(F.col("o_orderstatus"), F.lit("P")) == "O")
    return t.orders.filter(~both).select("o_orderkey")


@query("flt_case_predicate", f"""
with {SQL_ORDERS} select o_orderkey, site from so
where case site when 'ASIA' then c_acctbal when 'EUROPE' then c_acctbal - 1000 when 'AFRICA' then o_totalprice - 100000 end > 0""")
def flt_case_predicate(t):
    bal = F.col("c_acctbal")
    case = F.when(F.col("site") == "ASIA", bal).when(F.col("site") == "EUROPE", bal - 1000).when(F.col("site") == "AFRICA", F.col("o_totalprice") - 100000)
    return site_orders(t).filter(case > 0).select("o_orderkey", "site")


@query("flt_scalar_subquery", """
select event_id, event_type from events where cast(ts as date) = (select max(cast(ts as date)) from events)""")
def flt_scalar_subquery(t):
    last = t.events.agg(F.date_trunc("day", F.max("ts")).alias("d")).scalar()
    # ts >= the start of the last day: the subquery's value reaches the scan as a plain bound.
    return t.events.filter(F.col("ts") >= last).select("event_id", "event_type")


@query("flt_nonzero", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount from lineitem where l_discount <> 0")
def flt_nonzero(t):
    return t.lineitem.filter("l_discount != 0").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")


@query("flt_period_dependent", """
select o_orderkey from orders where case when year(o_orderdate) < 1998 then o_orderstatus = 'F' else o_orderpriority = '2-HIGH' end""")
def flt_period_dependent(t):
    cond = F.when(F.year("o_orderdate") < 1998, F.col("o_orderstatus") == "F").otherwise(F.col("o_orderpriority") == "2-HIGH")
    return t.orders.filter(cond).select("o_orderkey")


@query("flt_open_period", """
with w as (select o_orderkey, cast(date_trunc('week', o_orderdate) as date) + 6 as week_end from orders)
select o_orderkey, week_end from w where week_end < date '1999-06-30'""")
def flt_open_period(t):
    end = F.date_add(F.to_date(F.date_trunc("week", "o_orderdate")), 6)
    return t.orders.select("o_orderkey", end.alias("week_end")).filter(F.col("week_end") < F.lit(AS_OF))
