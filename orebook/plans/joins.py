"""Joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from orebook.functions.text import clean_item
from orebook.operators import joins as J
from orebook.operators.timegrid import missing_keys, spine_by_site
from orebook.plans.registry import query
from orebook.sources.tables import reference_table
from orebook.plans.shapes import (
    AS_OF, SITES, SQL_LIFE, SQL_LINES, SQL_ORDERS, SQL_SITES, customer_sites, dbl, dec, nation_sites, order_life, site_lines,
    site_orders,
)


@query("join_left_enrich", """
select o_orderkey, o_custkey, c_name, c_mktsegment from orders left join customer on o_custkey = c_custkey and c_acctbal > 0""")
def join_left_enrich(t):
    c = t.customer.filter("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("join_left_multi_key", """
with shipped as (select l_orderkey, l_suppkey, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty
                 from lineitem where l_returnflag <> 'R' group by 1, 2)
select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, n, qty from lineitem l
left join shipped s on l.l_orderkey = s.l_orderkey and l.l_suppkey = s.l_suppkey""")
def join_left_multi_key(t):
    shipped = t.lineitem.filter("l_returnflag != 'R'").groupBy("l_orderkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), dbl(F.sum(dec("l_quantity"))).alias("qty")
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(shipped, ["l_orderkey", "l_suppkey"], "left")


@query("join_inner", f"""
with {SQL_ORDERS} select o_orderkey, c_name, n_name, site from so""")
def join_inner(t):
    return site_orders(t).select("o_orderkey", "c_name", "n_name", "site")


KEYED_ITEM = "p_partkey || case p_type when 'ECONOMY' then '_1' when 'LARGE' then '_1-P.BO' when 'SMALL' then '-P' when 'PROMO' then '.CO' else '' end"


def keyed_item(t):
    suffix = (F.when(F.col("p_type") == "ECONOMY", "_1").when(F.col("p_type") == "LARGE", "_1-P.BO")
              .when(F.col("p_type") == "SMALL", "-P").when(F.col("p_type") == "PROMO", ".CO").otherwise(""))
    return F.concat(F.col("p_partkey").cast("string"), suffix)


ITEM_RE = r"(_1(-P)?(\.(BO|CO|MO|MC))?|-P(\.(BO|CO|MO|MC))?|\.(BO|CO|MO|MC))$"


@query("join_expr_key", f"""
with item as (select {KEYED_ITEM} as item, p_size from part),
     sold as (select cast(l_partkey as varchar) as item_clean, count(*) as n from lineitem group by 1)
select item, p_size, n from item left join sold on regexp_replace(item, '{ITEM_RE}', '') = item_clean""")
def join_expr_key(t):
    sold = t.lineitem.groupBy(F.col("l_partkey").cast("string").alias("item_clean")).agg(F.count(F.lit(1)).alias("n"))
    items = t.part.select(keyed_item(t).alias("item"), "p_size").withColumn("item_clean", clean_item(F.col("item")))
    return items.join(sold, "item_clean", "left").drop("item_clean")


@query("join_self_agg", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, n from (
  select *, count(*) over (partition by l_orderkey) as n from lineitem) where n > 4""")
def join_self_agg(t):
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 4")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(counts, "l_orderkey")


SQL_RATES = """rates as (
  select o_orderpriority as ccy, cast(date_trunc('month', o_orderdate) as date) as rate_date,
         cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*) / 100000 as rate
  from orders where o_orderpriority <> '3-MEDIUM' group by 1, 2)"""


def monthly_rates(t):
    """A rate table: per order priority, effective on the first of each month; one priority has none."""
    o = t.orders.filter("o_orderpriority != '3-MEDIUM'")
    return o.groupBy(F.col("o_orderpriority").alias("ccy"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("rate_date")).agg(
        (dbl(F.sum(dec("o_totalprice"))) / F.count(F.lit(1)) / 100000).alias("rate")
    )


def dated_orders(t):
    return t.orders.select("o_orderkey", F.col("o_orderpriority").alias("ccy"), F.to_date("o_orderdate").alias("order_date"), "o_totalprice")


@query("join_range_asof_two_step", f"""
with {SQL_RATES}, keys as (select distinct o_orderpriority as ccy, cast(o_orderdate as date) as d from orders),
 best as (select k.ccy, k.d, max(rate_date) as rate_date from keys k left join rates r on k.ccy = r.ccy and rate_date <= d group by 1, 2)
select o_orderkey, b.ccy, b.d as order_date, b.rate_date, r.rate
from orders join best b on o_orderpriority = b.ccy and cast(o_orderdate as date) = b.d
left join rates r on b.ccy = r.ccy and b.rate_date = r.rate_date""")
def join_range_asof_two_step(t):
    return J.asof_join(dated_orders(t).drop("o_totalprice"), monthly_rates(t), "ccy", "order_date", "rate_date", ["rate"])


@query("join_asof_timestamp", """
with view as (select event_type, cast(ts as timestamp) as ts, event_id, value, user_id from events where event_type <> 'error'),
 error as (select event_type, ts, max({'value': value, 'user_id': user_id}) as r from (
   select case when user_id % 3 = 0 then 'click' else 'view' end as event_type, cast(ts as timestamp) as ts, value, user_id from events where event_type = 'error') group by 1, 2)
select event_id, view.event_type, cast(strftime(view.ts, '%Y-%m-%d %H:%M:%S.%f') as varchar) as at, cast(strftime(error.ts, '%Y-%m-%d %H:%M:%S.%f') as varchar) as since, r.value as last_value, r.user_id as last_user
from view asof left join error on view.event_type = error.event_type and view.ts >= error.ts""")
def join_asof_timestamp(t):
    """The last error before each event, by kind of event and time; a kind's time is cut into days."""
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    facts = events.filter("event_type <> 'error'").select("event_id", "event_type", "ts")
    history = events.filter("event_type = 'error'").select(
        F.when(F.col("user_id") % 3 == 0, "click").otherwise("view").alias("event_type"), F.col("ts").alias("since"), "value", "user_id")
    found = J.asof_join(facts, history, "event_type", "ts", "since", ["value", "user_id"], chunk=lambda at: F.to_date(at))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return found.select("event_id", "event_type", text("ts").alias("at"), text("since").alias("since"), F.col("value").alias("last_value"), F.col("user_id").alias("last_user"))


SQL_TARGETS = """targets(site, effective_from, target) as (values
  ('AFRICA', date '1995-06-01', 20), ('AFRICA', date '1997-01-01', 25), ('ASIA', date '1996-01-01', 18),
  ('EUROPE', date '1995-01-01', 22), ('EUROPE', date '1998-07-01', 30), ('MIDEAST', date '1999-01-01', 15))"""
TARGETS = [
    ("AFRICA", dt.date(1995, 6, 1), 20), ("AFRICA", dt.date(1997, 1, 1), 25), ("ASIA", dt.date(1996, 1, 1), 18),
    ("EUROPE", dt.date(1995, 1, 1), 22), ("EUROPE", dt.date(1998, 7, 1), 30), ("MIDEAST", dt.date(1999, 1, 1), 15),
]


def targets(t):
    return reference_table(t.spark, TARGETS, "site string, effective_from date, target int")


@query("join_lateral_top1", f"""
with {SQL_ORDERS}, {SQL_TARGETS}
select o_orderkey, site, order_date, x.target from so left join lateral (
  select target from targets r where r.site = so.site and r.effective_from <= so.order_date order by r.effective_from desc limit 1) x on true""")
def join_lateral_top1(t):
    facts = site_orders(t).select("o_orderkey", "site", "order_date")
    return J.latest_effective(facts, targets(t), "site", "order_date", "effective_from", ["target"])


SQL_BANDS = """bands(c_mktsegment, band, goal, payout) as (values
  ('BUILDING', 0.0, 0.0, 0), ('BUILDING', 0.8, 2000.0, 10), ('BUILDING', 1.0, 5000.0, 20), ('MACHINERY', 0.0, 0.0, 0),
  ('MACHINERY', 1.0, 4000.0, 15), ('HOUSEHOLD', 0.9, 1000.0, 5), ('HOUSEHOLD', 1.1, 9000.0, 50), ('FURNITURE', 1.0, 3000.0, 12))"""
BANDS = [
    ("BUILDING", 0.0, 0.0, 0), ("BUILDING", 0.8, 2000.0, 10), ("BUILDING", 1.0, 5000.0, 20), ("MACHINERY", 0.0, 0.0, 0),
    ("MACHINERY", 1.0, 4000.0, 15), ("HOUSEHOLD", 0.9, 1000.0, 5), ("HOUSEHOLD", 1.1, 9000.0, 50), ("FURNITURE", 1.0, 3000.0, 12),
]


@query("join_band_top1", f"""
with {SQL_BANDS}, x as (
  select c_custkey, c.c_mktsegment, cast(band as double) as band, payout,
         row_number() over (partition by c_custkey order by band desc nulls last) as rn
  from customer c left join bands b on c.c_mktsegment = b.c_mktsegment and c_acctbal >= goal)
select c_custkey, c_mktsegment, band, payout from x where rn = 1""")
def join_band_top1(t):
    bands = reference_table(t.spark, BANDS, "c_mktsegment string, band double, goal double, payout int")
    out = J.top_band(t.customer, ["c_custkey"], bands, ["c_mktsegment"], "c_acctbal", "goal", "band", ["payout"])
    return out.select("c_custkey", "c_mktsegment", "band", "payout")


@query("join_theta_neq", f"""
with {SQL_LINES}, have as (
  select l_partkey, site, sum(cast(l_quantity as decimal(18,2))) as stock from ln where l_returnflag = 'R' group by 1, 2),
need as (select l_partkey, site, sum(cast(l_quantity as decimal(18,2))) as need from ln where l_returnflag = 'A' group by 1, 2)
select n.l_partkey, n.site as short_site, h.site as donor_site, cast(need as double) as need, cast(stock as double) as stock
from need n join have h on n.l_partkey = h.l_partkey and n.site <> h.site where need <= stock""")
def join_theta_neq(t):
    # Both sides are one row per (item, site): an item meets at most sites x (sites - 1) pairs.
    lines = site_lines(t).select("l_partkey", "site", "l_returnflag", dec("l_quantity").alias("q"))
    have = lines.filter("l_returnflag = 'R'").groupBy("l_partkey", F.col("site").alias("donor_site")).agg(F.sum("q").alias("stock"))
    need = lines.filter("l_returnflag = 'A'").groupBy("l_partkey", F.col("site").alias("short_site")).agg(F.sum("q").alias("need"))
    out = need.join(have, "l_partkey").filter("short_site != donor_site and need <= stock")
    return out.select("l_partkey", "short_site", "donor_site", dbl("need").alias("need"), dbl("stock").alias("stock"))


@query("join_spine_expand", f"""
with {SQL_LIFE}, days as (select cast(unnest(generate_series((select min(order_date) from life), date '1999-06-29', interval 1 day)) as date) as dt),
 sites as (select distinct site from life)
select dt, s.site,
  (select count(*) from life l where l.site = s.site and l.order_date <= dt and (l.invoice_date is null or l.invoice_date > dt)) as open_orders
from days cross join sites s""")
def join_spine_expand(t):
    from orebook.operators.backlog import backlog_daily

    return backlog_daily(order_life(t), "site", "order_date", "invoice_date", AS_OF).select("dt", "site", "open_orders")


@query("join_cross", f"""
with {SQL_SITES}, days as (select cast(unnest(generate_series((select min(cast(o_orderdate as date)) from orders), date '1999-06-30', interval 1 day)) as date) as dt)
select n_name, site, dt from ns cross join days""")
def join_cross(t):
    lo = t.orders.agg(F.to_date(F.min("o_orderdate"))).scalar()
    return spine_by_site(nation_sites(t).select("n_name", "site"), lo, F.lit(AS_OF))


@query("join_semi_in", """
select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_quantity > 45 and l_returnflag = 'R')""")
def join_semi_in(t):
    hot = t.lineitem.filter("l_quantity > 45 and l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(hot, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("join_anti_logged", """
select o_orderkey, cast(o_orderdate as date) as order_date from orders
where cast(o_orderdate as date) not in (select distinct cast(o_orderdate as date) from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P')""")
def join_anti_logged(t):
    logged = t.orders.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("order_date"))
    return missing_keys(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("order_date")), logged, ["order_date"])


@query("join_scope_expand", f"""
with {SQL_LINES}, keys as (select distinct l_partkey, site from ln where c_name ilike '%00%7')
select l_orderkey, l_linenumber, ln.l_partkey, l_suppkey, ln.site, c_name ilike '%00%7' as in_scope
from ln left join keys k on ln.l_partkey = k.l_partkey and ln.site = k.site
where c_name ilike '%00%7' or k.site is not null""")
def join_scope_expand(t):
    scope = F.col("c_name").ilike("%00%7")
    lines = site_lines(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "site", "c_name")
    out = J.scope_expand(lines, scope, ["l_partkey", "site"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "site", scope.alias("in_scope"))


@query("join_full_outer_fill", """
with a as (select l_suppkey as k, cast(sum(cast(l_quantity as decimal(18,2))) as double) as regular from lineitem where l_returnflag = 'R' and l_linenumber = 1 group by 1),
     b as (select l_suppkey as k, cast(sum(cast(l_quantity as decimal(18,2))) as double) as overtime from lineitem where l_returnflag = 'A' and l_linenumber = 7 group by 1)
select coalesce(a.k, b.k) as k, coalesce(regular, 0) as regular, coalesce(overtime, 0) as overtime, coalesce(regular, 0) + coalesce(overtime, 0) as total
from a full join b on a.k = b.k""")
def join_full_outer_fill(t):
    part = lambda cond, name: t.lineitem.filter(cond).groupBy(F.col("l_suppkey").alias("k")).agg(dbl(F.sum(dec("l_quantity"))).alias(name))
    a = part("l_returnflag = 'R' and l_linenumber = 1", "regular")
    b = part("l_returnflag = 'A' and l_linenumber = 7", "overtime")
    return a.join(b, "k", "full").fillna(0.0).withColumn("total", F.col("regular") + F.col("overtime"))


@query("join_drop_unmatched", f"""
with {SQL_SITES} select c_custkey, site from customer join ns on c_nationkey = n_nationkey and site <> 'ASIA'""")
def join_drop_unmatched(t):
    known = nation_sites(t).filter("site != 'ASIA'")
    return t.customer.join(known, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "site")
