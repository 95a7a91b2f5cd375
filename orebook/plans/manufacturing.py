"""Composite operators: jobs, usage, routes, yields, calendar, machine events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from orebook.functions import text as X
from orebook.operators import jobs as JB
from orebook.operators import machine as M
from orebook.operators import rollup as R
from orebook.operators import timegrid as G
from orebook.operators import yields as Y
from orebook.plans.joins import SQL_RATES, monthly_rates
from orebook.plans.registry import query
from orebook.sources.tables import reference_table
from orebook.plans.scalars import STAR, star_item
from orebook.plans.shapes import AS_OF, PRICE, SQL_LINES, SQL_ORDERS, SQL_SITES, customer_sites, dbl, dec, nation_sites, site_lines, site_orders, supplier_sites
from orebook.plans.windows import EVENT_PRIORITY, SQL_EVENT_PRIORITY

# A job is the work for one (order, line number) of the given lines.
SQL_JOB = """job_rows as (
  select l_orderkey * 8 + l_linenumber as job, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_linestatus, l_tax, l_discount,
    cast(l_quantity as decimal(18,2)) as qty, cast(l_extendedprice as decimal(18,2)) as usd, o_totalprice, site, p_type, p_retailprice,
    case when l_returnflag = 'R' then 'LBS' when l_returnflag = 'A' then 'MT' when l_linestatus = 'O' then 'KGS' else 'FT' end as uom
  from ln join part on l_partkey = p_partkey)"""


def job_rows(t):
    uom = (F.when(F.col("l_returnflag") == "R", "LBS").when(F.col("l_returnflag") == "A", "MT")
           .when(F.col("l_linestatus") == "O", "KGS").otherwise("FT"))
    return site_lines(t).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("job"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_returnflag", "l_linestatus", "l_tax", "l_discount", dec("l_quantity").alias("qty"), dec("l_extendedprice", PRICE).alias("usd"),
        "o_totalprice", "site", "p_type", "p_retailprice", uom.alias("uom"),
    )


@query("op_job_rollup", f"""
with {SQL_LINES}, {SQL_JOB}
select job, min(site) as site, min(cast(l_shipdate as date)) as start_date, max(l_partkey) as component, max(cast(qty as double)) as qty, max(o_totalprice) as cost, max(l_tax) as rate,
  max(o_totalprice) * max(l_tax) as cost_usd from job_rows group by 1""")
def op_job_rollup(t):
    rows = job_rows(t).select("job", "site", F.to_date("l_shipdate").alias("start_date"), F.col("l_partkey").alias("component"), dbl("qty").alias("qty"),
                              F.col("o_totalprice").alias("cost"), F.col("l_tax").alias("rate"))
    return JB.job_rollup(rows, "job", ["site", "start_date"], ["component", "qty"], "cost", "rate")


_LBS = "case max(uom) when 'LBS' then coalesce(max(q), 0) when 'MT' then coalesce(max(q), 0) * coalesce(max(w), 0) * cast(2.2046 as double) when 'KGS' then coalesce(max(q), 0) * cast(2.2046 as double) else coalesce(max(q), 0) * coalesce(max(w), 0) end"


def usage_rows(t):
    return job_rows(t).select("job", dbl("qty").alias("q"), "uom", F.nullif(F.col("l_tax"), F.lit(0)).alias("w"), F.col("o_totalprice").alias("cost"), F.col("l_discount").alias("rate"))


@query("op_usage_actual", f"""
with {SQL_LINES}, {SQL_JOB}, u as (select job, cast(qty as double) as q, uom, nullif(l_tax, 0) as w, o_totalprice as cost, l_discount as rate from job_rows)
select job, max(q) as q, {_LBS} as issued_lbs, max(cost) * max(rate) as issued_usd from u group by 1""")
def op_usage_actual(t):
    return JB.job_usage(usage_rows(t), "job", "q", "uom", "w", "cost", "rate")


@query("op_usage_expected", f"""
with {SQL_LINES}, {SQL_JOB}, u as (select job, cast(qty as double) * 2 as q, uom, nullif(l_tax, 0) as w from job_rows)
select job, max(q) as q, {_LBS} as expected_lbs from u group by 1""")
def op_usage_expected(t):
    return JB.job_usage(usage_rows(t).withColumn("q", F.col("q") * 2), "job", "q", "uom", "w", name="expected")


OP_NAMES = [("ECONOMY", "Cut"), ("LARGE", "Saw"), ("MEDIUM", "Drill"), ("PROMO", "Pack"), ("SMALL", "Inspect")]
OP_RANKS = [("Cut", 3), ("Saw", 1), ("Drill", 2)]
SQL_ROUTE = """route as (
   select l_orderkey, string_agg(code, ' → ' order by l_linenumber, code) as op_codes, string_agg(op, ' → ' order by l_linenumber, code) as op_names,
     arg_min(code, nr) as loss_op_code, arg_min(op, nr) as loss_op_name, min(nr) as loss_rank
   from (select distinct l_orderkey, l_linenumber, p_type as code, map {'ECONOMY': 'Cut', 'LARGE': 'Saw', 'MEDIUM': 'Drill', 'PROMO': 'Pack', 'SMALL': 'Inspect'}[p_type] as op,
       map {'ECONOMY': 3, 'LARGE': 1, 'MEDIUM': 2}[p_type] as nr
     from lineitem join part on l_partkey = p_partkey) group by l_orderkey)"""


def routes(t, key="l_orderkey"):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_type").alias("code"))
    steps = JB.route_steps(rows, "l_orderkey", "l_linenumber", "code")
    names = reference_table(t.spark, OP_NAMES, "op_code string, op_name string")
    ranks = reference_table(t.spark, OP_RANKS, "op_name string, rank int")
    return JB.route_attribution(steps, "l_orderkey", "l_linenumber", "code", names, ranks)


@query("op_route_attribution", f"with {SQL_ROUTE} select * from route")
def op_route_attribution(t):
    return routes(t)


@query("op_route_steps", "select distinct l_orderkey, l_linenumber, l_returnflag as op from lineitem")
def op_route_steps(t):
    return JB.route_steps(t.lineitem.withColumnRenamed("l_returnflag", "op"), "l_orderkey", "l_linenumber", "op")


@query("op_order_job_link", f"""
with {SQL_LINES}, {SQL_JOB},
 order_lines as (select cast(l_orderkey as varchar) as so_nbr, cast(l_linenumber as varchar) as so_line, '1' as so_shipment, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sales_usd from lineitem group by 1, 2),
 linked as (
   select job, case when own > 0 then 'default' when made[3] <> '' then 'assembly' end as link_source, case when own > 0 then nbr when made[3] <> '' then made[1] end as so_nbr,
     case when own > 0 then line when made[3] <> '' then made[2] end as so_line, case when own > 0 then '1' when made[3] <> '' then made[3] end as so_shipment
   from (select job, count_if(l_linestatus = 'O') as own, min(cast(l_orderkey as varchar)) filter (where l_linestatus = 'O') as nbr,
       min(cast(l_linenumber as varchar)) filter (where l_linestatus = 'O') as line,
       string_split(min(l_orderkey || '*' || l_linenumber || '*' || if(l_returnflag = 'R', '1', '')), '*') as made from job_rows group by job)),
 expected as (select job, cast(sum(qty) as double) as expected_qty from job_rows where l_returnflag <> 'N' group by 1), actual as (select job, cast(sum(qty) as double) as issued_qty from job_rows where l_returnflag = 'R' group by 1),
 r as (select job, string_agg(p_type, ' → ' order by l_suppkey, p_type) as route from (select distinct job, l_suppkey, p_type from job_rows) group by 1)
select o.so_nbr, o.so_line, o.so_shipment, sales_usd, j.job, link_source, expected_qty, issued_qty, route from order_lines o
left join linked j on o.so_nbr = j.so_nbr and o.so_line = j.so_line and o.so_shipment = j.so_shipment left join expected e on j.job = e.job left join actual a on j.job = a.job left join r on j.job = r.job""")
def op_order_job_link(t):
    txt = lambda c: F.col(c).cast("string")
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(dbl(F.sum(dec("l_extendedprice", PRICE))).alias("sales_usd")).select(
        txt("l_orderkey").alias("so_nbr"), txt("l_linenumber").alias("so_line"), F.lit("1").alias("so_shipment"), "sales_usd")
    rows = t.lineitem.withColumns({"job": F.col("l_orderkey") * 8 + F.col("l_linenumber"), "qty": dec("l_quantity")}).join(
        t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
    is_open, star, flag = F.col("l_linestatus") == "O", F.lit("*"), F.col("l_returnflag")
    item = F.concat(txt("l_orderkey"), star, txt("l_linenumber"), F.when(flag == "R", "*1").otherwise("*"))
    # The lines are read twice: once by order line, once by job.
    jobs = JB.job_facts(rows, "job", "qty", flag != "N", flag == "R", "l_suppkey", "p_type", {
        "so_nbr": F.when(is_open, txt("l_orderkey")), "so_line": F.when(is_open, txt("l_linenumber")),
        "so_shipment": F.when(is_open, F.lit("1")), "item": item})
    linked = JB.link_jobs(jobs.withColumns({"expected_qty": dbl("expected_qty"), "issued_qty": dbl("issued_qty")}), "so_nbr", "so_line", "so_shipment", "item")
    return lines.join(linked.drop("item"), ["so_nbr", "so_line", "so_shipment"], "left")


# Yield by order: picked is every line, complete the lines not returned, engineered less the discount.
SQL_YIELD_IN = """yin as (select l_orderkey as job, cast(sum(cast(l_quantity as decimal(18,2))) as double) as picked_lbs, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as picked_usd,
   cast(sum(case when l_returnflag <> 'R' then cast(l_quantity as decimal(18,2)) end) as double) as complete_lbs,
   cast(sum(cast(l_quantity * (1 - l_discount) as decimal(18,4))) as double) as engineered_lbs from lineitem group by 1)"""
SQL_YIELD_OUT = SQL_YIELD_IN + """, yusd as (select *, picked_usd / nullif(picked_lbs, 0) * complete_lbs as complete_usd, picked_usd / nullif(picked_lbs, 0) * engineered_lbs as engineered_usd from yin),
 yout as (select *, picked_lbs - complete_lbs as yieldloss_lbs, picked_usd - complete_usd as yieldloss_usd, picked_lbs - engineered_lbs as yieldvar_lbs, picked_usd - engineered_usd as yieldvar_usd,
   complete_lbs / nullif(engineered_lbs, 0) as engineered_yield, complete_lbs / nullif(picked_lbs, 0) as actual_yield,
   complete_lbs / nullif(picked_lbs, 0) / nullif(complete_lbs / nullif(engineered_lbs, 0), 0) as yield_performance from yusd)"""


OUTPUT = {
    "out_picked_lbs": lambda: dec("l_quantity"), "out_picked_usd": lambda: dec("l_extendedprice", PRICE),
    "out_complete_lbs": lambda: F.when(F.col("l_returnflag") != "R", dec("l_quantity")),
    "out_engineered_lbs": lambda: (F.col("l_quantity") * (1 - F.col("l_discount"))).cast("decimal(18,4)"),
}


def yield_out(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("job")).agg(*[dbl(F.sum(c())).alias(n.removeprefix("out_")) for n, c in OUTPUT.items()])
    return Y.yield_output_basis(rows)


@query("op_yield_metrics_output_basis", f"with {SQL_YIELD_OUT} select * from yout")
def op_yield_metrics_output_basis(t):
    return yield_out(t)


# The expected output of a picked line is its pounds times the rate of its item in the order, of the order, or 1.
_RATE = "cast({a}(l_quantity) filter (where {c}) over (partition by {k}) / nullif({a}(l_quantity + l_linenumber) filter (where {c}) over (partition by {k}), 0) as decimal(18,6))"
SQL_BOM = f"""bom as (
  select job, picked_items, lbs as picked_lbs, usd as picked_usd, made as complete_lbs, made * (usd / nullif(lbs, 0)) as complete_usd, made / nullif(r, 0) as engineered_lbs,
    made / nullif(r, 0) * (usd / nullif(lbs, 0)) as engineered_usd, lbs - made as yieldloss_lbs, usd - made * (usd / nullif(lbs, 0)) as yieldloss_usd, lbs - made / nullif(r, 0) as yieldvar_lbs,
    usd - made / nullif(r, 0) * (usd / nullif(lbs, 0)) as yieldvar_usd, r as engineered_yield, made / nullif(lbs, 0) as actual_yield, made / nullif(lbs, 0) / nullif(r, 0) as yield_performance
  from (select job, picked_items, lbs, usd, made, cast(out_lbs as double) / nullif(lbs, 0) as r from (
    select l_orderkey as job, string_agg(distinct cast(l_partkey as varchar), ', ' order by cast(l_partkey as varchar)) filter (where taken) as picked_items,
      cast(sum(q) filter (where taken) as double) as lbs, cast(sum(cast(l_extendedprice as decimal(18,2))) filter (where taken) as double) as usd,
      cast(sum(q) filter (where l_returnflag = 'A') as double) as made, sum(q * coalesce(item_rate, order_rate, 1)) filter (where taken) as out_lbs
    from (select *, l_returnflag <> 'A' as taken, cast(l_quantity as decimal(18,2)) as q, {_RATE.format(a="max", c="l_linestatus = 'O'", k="l_orderkey, l_partkey")} as item_rate,
        {_RATE.format(a="sum", c="l_linenumber <= 3", k="l_orderkey")} as order_rate from lineitem)
    group by l_orderkey having bool_or(taken))))"""

RATE = "decimal(18,6)"


def line_facts(rows, sums=None, greatest=None):
    """What both bases need of each order and item, from rows with ``l_orderkey`` and ``l_partkey``."""
    flag, qty = F.col("l_returnflag"), F.col("l_quantity")
    return Y.order_item_facts(rows, "l_orderkey", "l_partkey", dec("l_quantity"), dec("l_extendedprice", PRICE), qty, qty + F.col("l_linenumber"),
                              flag != "A", F.col("l_linestatus") == "O", F.col("l_linenumber") <= 3, flag == "A", RATE, sums, greatest)


def yield_bom(t):
    # Exact sums first, floating point from the order grain on.
    orders = Y.order_facts(line_facts(t.lineitem), "l_orderkey", "l_partkey", RATE, "double").filter("any_picked")
    return Y.yield_bom_basis(orders.drop("any_picked").withColumnRenamed("l_orderkey", "job"))


@query("op_yield_metrics_bom_basis", f"with {SQL_BOM} select * from bom")
def op_yield_metrics_bom_basis(t):
    return yield_bom(t)


def calendar(t):
    """The 4-4-5 calendar over the days of the orders."""
    lo, hi = F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))
    days = t.orders.agg(lo.alias("lo"), hi.alias("hi")).select(G.date_spine(F.col("lo"), F.col("hi")).alias("calendar_date"))
    return G.calendar_445(G.fiscal_445(days))


SQL_CAL = """cdays as (select cast(unnest(generate_series((select min(cast(o_orderdate as date)) from orders), (select max(cast(o_orderdate as date)) from orders), interval 1 day)) as date) as calendar_date),
 cw as (select calendar_date, cast(isoyear(calendar_date) + (week(calendar_date) = 53)::integer as integer) as fiscal_year, cast(case when week(calendar_date) = 53 then 1 else week(calendar_date) end as integer) as fiscal_week,
   case when week(calendar_date) = 53 then 1 else week(calendar_date) end as w from cdays),
 cm as (select *, cast(case when (w - 1) % 13 < 4 then (w - 1) // 13 * 3 + 1 when (w - 1) % 13 < 8 then (w - 1) // 13 * 3 + 2 else (w - 1) // 13 * 3 + 3 end as integer) as fiscal_month,
   cast(case when (w - 1) % 13 < 4 then (w - 1) % 13 + 1 when (w - 1) % 13 < 8 then (w - 1) % 13 - 3 else (w - 1) % 13 - 7 end as integer) as week_of_month from cw),
 cal as (select calendar_date, fiscal_year, fiscal_month, fiscal_week, week_of_month, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][fiscal_month] as month_name,
   fiscal_year * 100 + fiscal_month as fiscal_year_month_key, fiscal_year * 100 + fiscal_week as fiscal_year_week_key,
   min(calendar_date) over m as fiscal_month_start_date, max(calendar_date) over m as fiscal_month_end_date, min(calendar_date) over k as fiscal_week_start_date, max(calendar_date) over k as fiscal_week_end_date
   from cm window m as (partition by fiscal_year, fiscal_month), k as (partition by fiscal_year, fiscal_week))"""


@query("op_calendar_445", f"""
with {SQL_CAL} select cal.*, right(cast(fiscal_year as varchar), 2) || '-' || lpad(cast(fiscal_month as varchar), 2, '0') as fiscal_yy_mm, fiscal_year || '-' || lpad(cast(fiscal_month as varchar), 2, '0') as fiscal_yyyy_mm,
  month_name || '-' || right(cast(fiscal_year as varchar), 2) as fiscal_mon_yy, month_name || '-' || fiscal_year as fiscal_mon_yyyy from cal""")
def op_calendar_445(t):
    return calendar(t)


SINCE = dt.date(1995, 6, 1)
FISCAL = ("fiscal_year", "fiscal_month", "fiscal_week", "fiscal_year_month_key")
SQL_FINAL = """jobs0 as (select o_orderkey as job, cast(o_orderdate as date) as complete_date, site, case o_orderstatus when 'F' then 'Complete' when 'P' then 'Closed' else 'Released' end as prod_status, loss_op_name from so left join route on o_orderkey = l_orderkey),
 b1 as (select 'output' as basis, jobs0.*, null::varchar as picked_items, picked_lbs, picked_usd, complete_lbs, complete_usd, engineered_lbs, engineered_usd, yieldloss_lbs, yieldloss_usd, yieldvar_lbs, yieldvar_usd, engineered_yield, actual_yield, yield_performance from jobs0 join yout using (job)),
 b2 as (select 'bom' as basis, jobs0.*, picked_items, picked_lbs, picked_usd, complete_lbs, complete_usd, engineered_lbs, engineered_usd, yieldloss_lbs, yieldloss_usd, yieldvar_lbs, yieldvar_usd, engineered_yield, actual_yield, yield_performance from jobs0 join bom using (job)),
 fin as (select b.*, fiscal_year, fiscal_month, fiscal_week, fiscal_year_month_key from (select * from b1 union all select * from b2) b left join cal on complete_date = calendar_date
   where complete_date between date '1995-06-01' and date '1999-06-30' and prod_status in ('Complete', 'Closed') and complete_lbs <> -99999 and picked_lbs > 0 and loss_op_name <> 'Drill')"""
SQL_ALL_YIELD = f"{SQL_ORDERS}, {SQL_ROUTE}, {SQL_YIELD_OUT}, {SQL_BOM}, {SQL_CAL}, {SQL_FINAL}"


def final(t):
    """Both bases from one read of the lines: those of finished jobs, by order and item, then by order.

    The lines meet the finished jobs of the window first, which deals them out by order; neither aggregate, nor the join
    with the jobs' attributes, moves them again.
    """
    status = F.when(F.col("o_orderstatus") == "F", "Complete").when(F.col("o_orderstatus") == "P", "Closed").otherwise("Released")
    done = ("Complete", "Closed")
    jobs = site_orders(t).select(F.col("o_orderkey").alias("job"), F.col("order_date").alias("complete_date"), "site", status.alias("prod_status")).filter(
        F.col("complete_date").between(F.lit(SINCE), F.lit(AS_OF)) & F.col("prod_status").isin(*done))
    names = reference_table(t.spark, OP_NAMES, "op_code string, op_name string")
    ranks = reference_table(t.spark, OP_RANKS, "op_name string, rank int")
    ops = names.join(ranks, "op_name", "left").select("op_code", "op_name", "rank")
    lines = (t.lineitem.join(t.part.select("p_partkey", F.col("p_type").alias("op_code")), F.col("l_partkey") == F.col("p_partkey"), "left")
             .join(ops, "op_code", "left").join(jobs, F.col("l_orderkey") == F.col("job"), "left_semi"))
    # The loss belongs to the operation of the lowest rank on the route, of equal ranks to the greatest name.
    owner = F.when(F.col("rank").isNotNull(), F.struct((-F.col("rank")).alias("r"), F.col("op_name").alias("n")))
    facts = line_facts(lines, {n: c() for n, c in OUTPUT.items()}, {"__owner": owner})
    orders = Y.order_facts(facts, "l_orderkey", "l_partkey", RATE, "double", list(OUTPUT), ["__owner"]).withColumnsRenamed({"l_orderkey": "job"})
    orders = orders.join(jobs, "job").withColumn("loss_op_name", F.col("__owner.n"))
    measures = [*Y.MEASURES, "engineered_yield", "actual_yield", "yield_performance"]
    beside = Y.yield_bom_basis(orders).withColumnsRenamed({m: f"bom_{m}" for m in (*measures, "picked_items")})
    beside = Y.yield_output_basis(beside.withColumnsRenamed({n: n.removeprefix("out_") for n in OUTPUT}))

    def basis(name, items, prefix=""):
        return F.struct(F.lit(name).alias("basis"), items.cast("string").alias("picked_items"), *[F.col(prefix + m).alias(m) for m in measures])

    both = F.array(basis("output", F.lit(None)), F.when(F.col("any_picked"), basis("bom", F.col("bom_picked_items"), "bom_")))
    rows = beside.select("job", "complete_date", "site", "prod_status", "loss_op_name", F.inline(both)).filter("basis is not null")
    return Y.yield_final([rows], SINCE, AS_OF, "prod_status", done, "complete_date", "Drill", "loss_op_name", calendar(t).select("calendar_date", *FISCAL))


@query("op_yield_final", f"with {SQL_ALL_YIELD} select * from fin")
def op_yield_final(t):
    return final(t)


_flags = ", ".join(f"coalesce({{d}} between date '1999-06-29' - {n - 1} and date '1999-06-29', false) as is_trailing_{k}" for k, n in
                   {"1wk": 7, "2wk": 14, "4wk": 28, "8wk": 56, "12wk": 84, "26wk": 182}.items()) + \
    ", coalesce({d} between cast(date '1999-06-29' - interval 12 month as date) and date '1999-06-29', false) as is_ttm"


@query("op_trailing_flags", f"""
select o_orderkey, d, date '1999-06-29' as run_date, {_flags.format(d="d")} from (select o_orderkey, case when o_orderstatus <> 'O' then cast(o_orderdate as date) end as d from orders)""")
def op_trailing_flags(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.to_date("o_orderdate")).alias("d"))
    return Y.with_trailing_flags(rows, "d", AS_OF)


def exact(df):
    """Measures in whole ten-thousandths, so that sums do not depend on the order of rows."""
    return df.withColumns({m: F.round(F.col(m) * 10000).cast("decimal(28,0)") for m in Y.MEASURES})


@query("op_yield_site_op_date", f"""
with {SQL_ALL_YIELD}, flg as (select *, {_flags.format(d="complete_date")} from fin)
select site, loss_op_name, complete_date, fiscal_year_month_key, is_trailing_26wk, is_ttm, {", ".join(f"cast(sum(cast(round({m} * 10000) as decimal(28,0))) as double) / cast(10000 as double) as {m}" for m in Y.MEASURES)} from flg group by all""")
def op_yield_site_op_date(t):
    flagged = Y.with_trailing_flags(exact(final(t)), "complete_date", AS_OF)
    out = Y.sum_measures(flagged, ["site", "loss_op_name", "complete_date", "fiscal_year_month_key", "is_trailing_26wk", "is_ttm"])
    return out.withColumns({m: dbl(m) / F.lit(10000.0) for m in Y.MEASURES})


@query("op_yield_job_extract", f"""
with {SQL_ALL_YIELD} select basis, job, site, prod_status, complete_date, loss_op_name, picked_lbs, complete_lbs, actual_yield from fin where complete_date = date '1999-06-29'""")
def op_yield_job_extract(t):
    return Y.job_extract(final(t), "complete_date", AS_OF, ["basis", "job", "site", "prod_status", "complete_date", "loss_op_name", "picked_lbs", "complete_lbs", "actual_yield"])


@query("op_bom_expected", """
select l_orderkey, cast(sum(cast(l_quantity as decimal(18,2))) as double) as num, cast(sum(cast(l_tax as decimal(18,2))) as double) as den,
  cast(sum(cast(l_quantity as decimal(18,2))) as double) / nullif(cast(sum(cast(l_tax as decimal(18,2))) as double), 0) as expected_yield from lineitem group by 1""")
def op_bom_expected(t):
    bom = t.lineitem.select("l_orderkey", dec("l_quantity").alias("num"), dec("l_tax").alias("den"))
    out = JB.bom_expected(bom, ["l_orderkey"], "num", "den").withColumns({"num": dbl("num"), "den": dbl("den")})
    return out.withColumn("expected_yield", F.col("num") / F.nullif(F.col("den"), F.lit(0)))


@query("op_bom_type", """
select l_orderkey, count(distinct l_partkey) as items, count(distinct case when l_returnflag = 'R' then l_partkey end) as inputs, count(distinct case when l_returnflag = 'A' then l_partkey end) as outputs from lineitem group by 1""")
def op_bom_type(t):
    return JB.bom_type(t.lineitem, "l_orderkey", "l_partkey", {"inputs": F.col("l_returnflag") == "R", "outputs": F.col("l_returnflag") == "A"})


@query("op_produced_qty", """
select l_orderkey, l_partkey, cast(sum(cast(l_quantity as decimal(18,2))) as double) as complete_lbs from lineitem where l_returnflag = 'A' group by 1, 2""")
def op_produced_qty(t):
    rows = t.lineitem.filter("l_returnflag = 'A'").withColumn("q", dec("l_quantity"))
    return JB.produced_qty(rows, ["l_orderkey", "l_partkey"], "q").withColumn("complete_lbs", dbl("complete_lbs"))


@query("op_invoice_rollup", """
select l_orderkey, l_linenumber, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as invoiced_usd, cast(max(l_shipdate) as date) as last_date,
  string_agg(distinct 'I' || l_suppkey, ',' order by 'I' || l_suppkey) as invoice_ids from lineitem where l_returnflag <> 'N' group by 1, 2""")
def op_invoice_rollup(t):
    rows = t.lineitem.filter("l_returnflag != 'N'").withColumns({
        "invoiced_usd": dec("l_extendedprice", PRICE), "last_date": F.to_date("l_shipdate"), "invoice": F.concat(F.lit("I"), F.col("l_suppkey").cast("string")),
    })
    keys = ["l_orderkey", "l_linenumber"]
    sums = R.grain_rollup(rows, keys, last=["last_date"], sums=["invoiced_usd"]).withColumn("invoiced_usd", dbl("invoiced_usd"))
    return sums.join(R.distinct_text(rows, keys, "invoice", ",", "invoice_ids"), keys)


@query("op_order_line_rollup", """
select l_orderkey, l_linenumber, min(l_partkey) as item, cast(min(l_shipdate) as date) as promise_date, max(l_quantity) as ordered_qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as revenue
from lineitem where lower(l_returnflag) <> 'r' and l_extendedprice < 100000000 group by 1, 2""")
def op_order_line_rollup(t):
    rows = t.lineitem.filter((F.lower("l_returnflag") != "r") & (F.col("l_extendedprice") < 100_000_000)).select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("item"), F.to_date("l_shipdate").alias("promise_date"), F.col("l_quantity").alias("ordered_qty"), dec("l_extendedprice", PRICE).alias("revenue")
    )
    out = R.grain_rollup(rows, ["l_orderkey", "l_linenumber"], first=["item", "promise_date"], last=["ordered_qty"], sums=["revenue"])
    return out.withColumn("revenue", dbl("revenue"))


@query("op_interval_split_by_day", """
with b as (select event_id, user_id, ts, cast(value * 600 as decimal(18,6)) as sec from events where value * 600 > 0 and value * 600 < 10000),
 s as (select *, ts - to_microseconds(cast(round(sec * 1000000) as bigint)) as st from b),
 d as (select *, cast(unnest(generate_series(date_trunc('day', st), date_trunc('day', ts), interval 1 day)) as date) as event_date from s),
 a as (select event_id, user_id, event_date, date_diff('microsecond', greatest(st, cast(event_date as timestamp)), least(ts, cast(event_date as timestamp) + interval 1 day)) as us from d)
select event_id, user_id, event_date, us from a where us > 0""")
def op_interval_split_by_day(t):
    ev = t.events.select("event_id", "user_id", "ts", (F.col("value") * 600).alias("sec"))
    out = G.split_interval_by_day(ev, "ts", "sec")
    return out.select("event_id", "user_id", "event_date", (F.col("allocated_duration_sec") * 1000000).cast("bigint").alias("us"))


@query("op_machine_event_clean", f"""
select user_id, slot, event_id, event_type, value from (
  select user_id, cast(date_trunc('hour', ts) as timestamp) as slot, event_id, event_type, value, row_number() over (partition by user_id, date_trunc('hour', ts) order by {SQL_EVENT_PRIORITY}, event_id) as rn
  from events where event_type <> 'error') where rn = 1""")
def op_machine_event_clean(t):
    ev = t.events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("slot"), "event_id", "event_type", "value")
    return M.clean_events(ev, ["user_id", "slot"], "event_type", "event_type", ["event_id"], EVENT_PRIORITY, "error")


@query("op_latest_hour_batch", """
select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id) as rn from events
  where date_trunc('hour', ts) = (select date_trunc('hour', max(ts)) from events)) where rn = 1""")
def op_latest_hour_batch(t):
    return G.latest_hour_batch(t.events, "ts", ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("op_detect_site_from_rows", f"""
with {SQL_SITES}, sup as (select s_nationkey as file, s_suppkey as row_no, case when s_acctbal > 3000 then upper(n_name) else 'unknown' end as city from supplier join nation on s_nationkey = n_nationkey),
 hit as (select file, row_no, site from sup join ns on lower(city) = lower(n_name)) select file, min_by(site, row_no) as site from hit group by 1""")
def op_detect_site_from_rows(t):
    from orebook.sources.csv_files import site_of_files

    city = F.when(F.col("s_acctbal") > 3000, F.concat(F.lit(" "), F.upper("n_name"))).otherwise("unknown")
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("row_no"), city.alias("city"))
    return site_of_files(rows, "file", "row_no", "city", nation_sites(t).select(F.col("n_name").alias("city"), "site"))
