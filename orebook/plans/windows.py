"""Window functions, sorting, top-k, sets and generators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orebook.functions.dates import overlap_seconds
from orebook.functions.numbers import ratio
from orebook.operators import allocation as A
from orebook.operators import backlog as B
from orebook.operators import joins as J
from orebook.operators import machine as M
from orebook.operators import rollup as R
from orebook.operators import timegrid as G
from orebook.operators.running import running_totals, trailing_sums
from orebook.plans.joins import BANDS, SQL_BANDS, SQL_TARGETS, TARGETS, targets
from orebook.plans.registry import query
from orebook.sources.tables import reference_table
from orebook.plans.shapes import (
    AS_OF, HOLIDAYS, QUANTITY, SITES, SQL_LIFE, SQL_LINES, SQL_LINE_ORDER, SQL_ORDERS, SQL_SITES, add_site, dbl, dec, item_sizes, line_chunks,
    line_order, nation_sites, order_life, site_lines, site_orders,
)

EVENT_PRIORITY = {"purchase": 1, "signup": 2, "click": 3, "view": 4}
SQL_EVENT_PRIORITY = "case event_type when 'purchase' then 1 when 'signup' then 2 when 'click' then 3 when 'view' then 4 else 99 end"


@query("win_dedup_priority", f"""
select user_id, ev_date, event_type, event_id from (
  select user_id, cast(ts as date) as ev_date, event_type, event_id,
         row_number() over (partition by user_id, cast(ts as date) order by {SQL_EVENT_PRIORITY}, event_id) as rn from events) where rn = 1""")
def win_dedup_priority(t):
    ev = t.events.select("user_id", F.to_date("ts").alias("ev_date"), "event_type", "event_id")
    order = [M.status_priority(F.col("event_type"), EVENT_PRIORITY), F.col("event_id")]
    return J.keep_top(ev, ["user_id", "ev_date"], order)


@query("win_dedup_normalised_key", """
select p_name, p_size from (select p_name, p_size, row_number() over (partition by trim(lower(p_name)) order by p_name, p_size) as rn
  from (select case when p_size > 25 then upper(p_name) else p_name || ' ' end as p_name, p_size from part)) where rn = 1""")
def win_dedup_normalised_key(t):
    name = F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" ")))
    p = t.part.select(name.alias("p_name"), "p_size").withColumn("norm", F.trim(F.lower("p_name")))
    return J.keep_top(p, ["norm"], [F.col("p_name"), F.col("p_size")]).select("p_name", "p_size")


@query("win_rank_slots", """
select * from (select l_orderkey, l_partkey, l_suppkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as integer) as slot from lineitem) where slot <= 3""")
def win_rank_slots(t):
    out = J.keep_top(t.lineitem, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")], 3, rank="slot")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "slot")


@query("win_topband", f"""
with {SQL_BANDS}
select c_custkey, band, payout from (
  select c_custkey, cast(band as double) as band, payout, row_number() over (partition by c_custkey order by band desc) as rn
  from customer c join bands b on c.c_mktsegment = b.c_mktsegment and c_acctbal >= goal) where rn = 1""")
def win_topband(t):
    bands = reference_table(t.spark, BANDS, "c_mktsegment string, band double, goal double, payout int")
    out = J.top_band(t.customer, ["c_custkey"], bands, ["c_mktsegment"], "c_acctbal", "goal", "band", ["payout"])
    return out.filter("band is not null").select("c_custkey", "band", "payout")


@query("win_period_bounds", """
with d as (select distinct cast(o_orderdate as date) as d from orders)
select d, min(d) over (partition by year(d), month(d)) as month_start, max(d) over (partition by year(d), month(d)) as month_end,
  min(d) over (partition by date_trunc('week', d)) as week_start, max(d) over (partition by date_trunc('week', d)) as week_end from d""")
def win_period_bounds(t):
    d = t.orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    month, week = Window.partitionBy(F.year("d"), F.month("d")), Window.partitionBy(F.date_trunc("week", "d"))
    return d.select("d", F.min("d").over(month).alias("month_start"), F.max("d").over(month).alias("month_end"),
                    F.min("d").over(week).alias("week_start"), F.max("d").over(week).alias("week_end"))


SQL_STOCK = """sup as (select s_suppkey, ns.site from supplier join ns on s_nationkey = n_nationkey),
 stock as (select l_partkey, sup.site, cast(sum(cast(l_quantity as decimal(18,2))) as decimal(18,2)) as on_hand
   from lineitem join sup on l_suppkey = s_suppkey where l_returnflag = 'R' group by 1, 2),
 demand as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, site, promise_date, order_date, o_orderstatus,
     o_orderpriority, c_name, case when l_partkey % 2 = 0 then 'FOOT' else 'PCS' end as unit,
     case when l_returnflag = 'A' and l_linenumber = 7 then null when l_discount = 0 then 0 else cast(l_quantity as decimal(18,2)) end as required
   from ln where l_returnflag <> 'R')"""
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def stock(t):
    """Returned goods lie at the supplier's site."""
    back = t.lineitem.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey", dec("l_quantity").alias("q"))
    at = add_site(t, back.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")), "s_nationkey")
    return at.groupBy("l_partkey", "site").agg(F.sum("q").alias("on_hand"))


def demand(t):
    """Lines not returned want their quantity; some are issued (0) or unknown (null)."""
    required = (F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 7), None)
                .when(F.col("l_discount") == 0, F.lit(0)).otherwise(dec("l_quantity"))).cast(QUANTITY)
    unit = F.when(F.col("l_partkey") % 2 == 0, "FOOT").otherwise("PCS")
    lines = site_lines(t).filter("l_returnflag != 'R'")
    return lines.select(*KEYS, "l_quantity", "l_extendedprice", "site", "promise_date", "order_date", "o_orderstatus",
                        "o_orderpriority", "c_name", unit.alias("unit"), required.alias("required"))


@query("win_running_balance", f"""
with {SQL_LINES}, {SQL_STOCK}
select l_orderkey, l_linenumber, l_partkey, l_suppkey, site,
  cast(coalesce(on_hand, 0) - sum(coalesce(required, 0)) over (partition by l_partkey, site order by {SQL_LINE_ORDER} rows unbounded preceding) as double) as balance
from demand left join stock using (l_partkey, site)""")
def win_running_balance(t):
    out = A.home_tally(demand(t), stock(t), "l_partkey", "site", "required", line_order(), line_chunks(), sized_by=item_sizes(t))
    return out.select(*KEYS, "site", dbl("tally_home").alias("balance"))


@query("win_partition_floor", f"""
with {SQL_LINES}, {SQL_STOCK}, r as (
  select d.l_partkey, d.site, sum(case when l_linenumber = 3 then -coalesce(required, 0) else coalesce(required, 0) end)
    over (partition by d.l_partkey order by {SQL_LINE_ORDER} rows unbounded preceding) as used from demand d)
select l_partkey, cast(-max(used) as double) as floor from r group by 1""")
def win_partition_floor(t):
    """Lowest point of a balance that may rise again (negative requirements)."""
    need = F.coalesce(F.col("required"), F.lit(0))
    signed = F.when(F.col("l_linenumber") == 3, -need).otherwise(need)
    out = running_totals(demand(t), ["l_partkey"], line_order(), {"used": signed}, line_chunks(), peaks=True, sized_by=item_sizes(t))
    return out.groupBy("l_partkey").agg(dbl(-F.max("used_peak")).alias("floor"))


@query("win_cumulative_smallest_first", f"""
with {SQL_LINES}, {SQL_STOCK}
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(sum(required) over (partition by l_partkey, site
  order by required nulls last, {SQL_LINE_ORDER} rows unbounded preceding) as double) as cumulative from demand where required > 0""")
def win_cumulative_smallest_first(t):
    r = F.col("required")
    out = running_totals(demand(t).filter("required > 0"), ["l_partkey", "site"], [r.asc_nulls_last(), *line_order()],
                         {"cumulative": r}, [r, *line_chunks()], sized_by=item_sizes(t))
    return out.select(*KEYS, dbl("cumulative").alias("cumulative"))


# Each day of each site counts its orders anew; a week is the day and the six before it.
SQL_DAILY = SQL_LIFE + """,
 daily as (
   select dt, site, (select count(*) from life l where l.site = g.site and l.order_date = g.dt) as new_orders,
     (select count(*) from life l where l.site = g.site and l.invoice_date = g.dt) as shipped_orders,
     (select count(*) from life l where l.site = g.site and l.order_date <= g.dt and coalesce(l.invoice_date > g.dt, true)) as open_orders
   from (select cast(d as date) as dt, site from (select distinct site from life),
     generate_series((select min(order_date) from life)::timestamp, timestamp '1999-06-29', interval 1 day) as r(d)) g),
 worked as (select *, isodow(dt) < 6 as is_weekday, strftime(dt, '%Y-%m-%d') in ('1996-01-01', '1997-07-04', '1998-12-25') as is_holiday from daily),
 trend as (
   select a.dt, a.site, any_value(a.new_orders) as new_orders, any_value(a.shipped_orders) as shipped_orders, any_value(a.open_orders) as open_orders,
     any_value(a.is_weekday) as is_weekday, any_value(a.is_holiday) as is_holiday, any_value(a.is_weekday and not a.is_holiday) as is_business_day,
     round(cast(sum(b.new_orders) as double) / nullif(count_if(b.is_weekday and not b.is_holiday), 0), 1) as new_orders_week_avg,
     round(cast(sum(b.shipped_orders) as double) / nullif(count_if(b.is_weekday and not b.is_holiday), 0), 1) as shipped_orders_week_avg,
     round(avg(b.open_orders), 1) as backlog_week_avg
   from worked a join worked b on b.site = a.site and b.dt between a.dt - 6 and a.dt group by a.dt, a.site)"""


def daily(t):
    return B.backlog_daily(order_life(t), "site", "order_date", "invoice_date", AS_OF, HOLIDAYS)


@query("win_trailing_rows", f"""
with {SQL_DAILY} select dt, site, cast(sum(new_orders) over w as bigint) as new_7d, avg(open_orders) over w as open_avg from daily
window w as (partition by site order by dt rows between 6 preceding and current row)""")
def win_trailing_rows(t):
    w = Window.partitionBy("site").orderBy("dt").rowsBetween(-6, 0)
    return daily(t).select("dt", "site", F.sum("new_orders").over(w).alias("new_7d"), F.avg("open_orders").over(w).alias("open_avg"))


_LINE_PLACE = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"


@query("win_trailing_blocks", f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, cast(sum(cast(l_quantity as decimal(18,2))) over w as double) as qty_12,
  cast(sum(cast(l_extendedprice as decimal(18,2))) over w as double) / nullif(cast(sum(cast(l_quantity as decimal(18,2))) over w as double), 0) as price_12
from lineitem window w as (partition by l_returnflag order by {_LINE_PLACE} rows between 11 preceding and current row)""")
def win_trailing_blocks(t):
    """Sums of the last twelve lines and their ratio, over groups that each hold a third of all lines or more."""
    lines = t.lineitem.select("l_returnflag", "l_shipdate", *KEYS, "l_quantity", "l_extendedprice")
    order = [F.col("l_shipdate").asc_nulls_last(), *[F.col(c) for c in _LINE_PLACE.split(", ")[1:]]]
    out = trailing_sums(lines, ["l_returnflag"], order, {"qty": dec("l_quantity"), "usd": dec("l_extendedprice")},
                        [F.to_date("l_shipdate"), F.shiftright("l_orderkey", 20)], 12)
    return out.select(*KEYS, "l_quantity", "l_extendedprice", dbl("qty").alias("qty_12"), ratio(dbl("usd"), dbl("qty")).alias("price_12"))


@query("win_ratio_of_window_sums", f"with {SQL_DAILY} select dt, site, new_orders_week_avg, shipped_orders_week_avg from trend")
def win_ratio_of_window_sums(t):
    return daily(t).select("dt", "site", "new_orders_week_avg", "shipped_orders_week_avg")


@query("win_waterfall_offset", """
with c as (select o_orderpriority as stage, count(*) as value from orders group by 1),
 p as (select stage, value, cast(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], stage) as integer) as position from c)
select stage, position, value, cast(coalesce(sum(value) over (order by position rows between unbounded preceding and 1 preceding), 0) as bigint) as start_offset from p
union all select 'Total', 0, cast(sum(value) as bigint), 0 from p""")
def win_waterfall_offset(t):
    counts = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return B.waterfall(counts, "o_orderpriority", "n", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("sort_multi", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount > 0.05 as discounted, l_quantity from lineitem
order by discounted desc, l_quantity asc nulls last, l_orderkey, l_linenumber, l_partkey, l_suppkey""")
def sort_multi(t):
    out = t.lineitem.select(*KEYS, (F.col("l_discount") > 0.05).alias("discounted"), "l_quantity")
    return out.orderBy(F.desc_nulls_first("discounted"), F.asc_nulls_last("l_quantity"), *KEYS)


@query("topk_latest_effective", """
select o_custkey, o_orderkey, cast(o_orderdate as date) as order_date from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders where o_orderdate <= timestamp '1999-06-30') where rn = 1""")
def topk_latest_effective(t):
    past = t.orders.filter("o_orderdate <= timestamp_ntz'1999-06-30'").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    return past.groupBy("o_custkey").agg(F.max(F.struct("order_date", "o_orderkey")).alias("m")).select("o_custkey", "m.o_orderkey", "m.order_date")


@query("topk_tail_n", f"""
with {SQL_DAILY} select dt, cast(sum(open_orders) as bigint) as open_orders, cast(sum(new_orders) as bigint) as new_orders, cast(sum(shipped_orders) as bigint) as shipped_orders
from daily where site in ('ASIA', 'EUROPE') group by dt order by dt desc limit 90""")
def topk_tail_n(t):
    return B.trend_last_days(daily(t), "site", ["ASIA", "EUROPE"], 90)


@query("set_union_all", """
select o_orderkey as key, 'order' as kind, o_totalprice as amount, cast(o_orderdate as date) as day from orders
union all select l_orderkey, 'line', l_extendedprice, cast(l_shipdate as date) from lineitem""")
def set_union_all(t):
    a = t.orders.select(F.col("o_orderkey").alias("key"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("day"))
    b = t.lineitem.select(F.col("l_orderkey").alias("key"), F.lit("line").alias("kind"), F.col("l_extendedprice").alias("amount"), F.to_date("l_shipdate").alias("day"))
    return a.unionByName(b)


@query("set_concat_regions", f"""
with {SQL_ORDERS} select o_orderkey, site, cast(year(order_date) as integer) as year, case when site in ('ASIA', 'EUROPE') then c_acctbal end as hours
from so""")
def set_concat_regions(t):
    """Feeds of sites with and without a column, stacked."""
    orders = site_orders(t).select("o_orderkey", "site", F.year("order_date").alias("year"), "c_acctbal")
    full = orders.filter(F.col("site").isin("ASIA", "EUROPE")).withColumnRenamed("c_acctbal", "hours")
    rest = orders.filter(~F.col("site").isin("ASIA", "EUROPE")).drop("c_acctbal")
    return R.stack([full, rest]).select("o_orderkey", "site", "year", "hours")


@query("set_difference_missing", """
select n_name from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 8000)""")
def set_difference_missing(t):
    arrived = t.supplier.filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("n_nationkey"))
    return G.missing_keys(t.nation, arrived, ["n_nationkey"]).select("n_name")


@query("gen_date_spine", """
select cast(unnest(generate_series((select min(cast(o_orderdate as date)) from orders), date '1999-06-29', interval 1 day)) as date) as dt""")
def gen_date_spine(t):
    lo = t.orders.agg(F.to_date(F.min("o_orderdate")).alias("lo"))
    return lo.select(G.date_spine(F.col("lo"), F.date_sub(F.lit(AS_OF), 1)).alias("dt"))


@query("gen_interval_days", """
with b as (select event_id, ts, ts - to_microseconds(cast(round(cast(value * 60 as decimal(18,6)) * 1000000) as bigint)) as s from events)
select event_id, cast(unnest(generate_series(date_trunc('day', s), date_trunc('day', ts), interval 1 day)) as date) as event_date from b""")
def gen_interval_days(t):
    from orebook.functions.dates import seconds_before

    start = F.to_date(seconds_before(F.col("ts"), F.col("value") * 60))
    return t.events.select("event_id", G.date_spine(start, F.to_date("ts")).alias("event_date"))


@query("gen_spine_by_site", f"""
with {SQL_SITES}, days as (select cast(unnest(generate_series((select min(cast(o_orderdate as date)) from orders), date '1999-06-29', interval 1 day)) as date) as dt)
select distinct site, dt from ns cross join days""")
def gen_spine_by_site(t):
    lo = t.orders.agg(F.to_date(F.min("o_orderdate"))).scalar()
    return G.spine_by_site(nation_sites(t).select("site").distinct(), lo, F.date_sub(F.lit(AS_OF), 1))
