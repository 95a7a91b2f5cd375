"""Composite operators: earned hours, worked hours, payouts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from orebook.functions.dates import MONTHS, MONTH_NUMBER
from orebook.operators import hours as H
from orebook.operators import jobs as JB
from orebook.operators import productivity as P
from orebook.plans.aggregates import month_sheet
from orebook.plans.manufacturing import SQL_CAL, SQL_JOB, calendar, job_rows
from orebook.plans.registry import query
from orebook.sources.tables import reference_table
from orebook.plans.shapes import AS_OF, SQL_LINES, SQL_ORDERS, SQL_SITES, customer_sites, dbl, dec, nation_sites, site_lines, site_orders

# Hours are kept as decimals until the last step: their sums do not depend on row order.
HRS = "decimal(28,6)"

SQL_EARNED = SQL_JOB + f""", eh0 as (select l_orderkey as job, l_returnflag as op, max(site) as site, max(cast(qty as {HRS})) as qty, sum(cast(l_tax * 100 as {HRS})) as raw from job_rows group by 1, 2),
 eh1 as (select *, case when op = 'R' then cast(qty * 0.0125 + 0.08333333 as {HRS}) when op = 'A' and site = 'EUROPE' then cast(raw * 0.25 as {HRS})
    when op = 'N' and site = 'ASIA' then cast((qty + 5) * 0.0166666667 as {HRS}) else raw end as calc,
    (op = 'R' or (op = 'A' and site = 'EUROPE') or (op = 'N' and site = 'ASIA')) as calc_adjusted from eh0),
 manual as (select o_orderkey as job, 'A' as op, cast(1.5 as {HRS}) as manual_hrs from orders where o_totalprice < 5000),
 incl(site, op, include) as (values ('AFRICA', 'R', true), ('AFRICA', 'A', true), ('ASIA', 'N', true), ('ASIA', 'R', false), ('EUROPE', 'A', true), ('EUROPE', 'R', true), ('MIDEAST', 'N', true)),
 eh as (select e.job, e.op, e.site, qty, raw, calc, coalesce(manual_hrs, calc) as earned_hours, manual_hrs is not null as manual_adjusted, calc_adjusted, include
   from eh1 e left join manual m on e.job = m.job and e.op = m.op left join incl i on e.site = i.site and e.op = i.op)"""
INCLUDE = [("AFRICA", "R", True), ("AFRICA", "A", True), ("ASIA", "N", True), ("ASIA", "R", False), ("EUROPE", "A", True), ("EUROPE", "R", True), ("MIDEAST", "N", True)]


def earned(t):
    rows = job_rows(t).select(F.col("l_orderkey").alias("job"), F.col("l_returnflag").alias("op"), "site", F.col("qty").cast(HRS).alias("qty"),
                              (F.col("l_tax") * 100).cast(HRS).alias("hours"))
    op, site, q = F.col("op"), F.col("site"), F.col("qty")
    d = lambda x, s: F.lit(x).cast(s)
    formulas = [
        (op == "R", (q * d("0.0125", "decimal(10,4)") + d("0.08333333", "decimal(10,8)")).cast(HRS)),
        ((op == "A") & (site == "EUROPE"), (F.col("raw_hours") * d("0.25", "decimal(10,2)")).cast(HRS)),
        ((op == "N") & (site == "ASIA"), ((q + 5) * d("0.0166666667", "decimal(12,10)")).cast(HRS)),
    ]
    manual = t.orders.filter("o_totalprice < 5000").select(F.col("o_orderkey").alias("job"), F.lit("A").alias("op"), F.lit("1.5").cast(HRS).alias("manual_hrs"))
    include = reference_table(t.spark, INCLUDE, "site string, op string, include boolean")
    return JB.earned_hours(rows, "job", "op", "site", "qty", "hours", formulas, manual, include)


@query("op_earned_hours", f"""
with {SQL_LINES}, {SQL_EARNED} select job, op, site, cast(qty as double) as qty, cast(raw as double) as raw_hours, cast(calc as double) as calc_hours, cast(earned_hours as double) as earned_hours, manual_adjusted, calc_adjusted, include from eh""")
def op_earned_hours(t):
    out = earned(t)
    return out.withColumns({c: dbl(c) for c in ("qty", "raw_hours", "calc_hours", "earned_hours")})


# Activity hours: click events by day, site by user.
SQL_ACTIVITY = f"""act as (select case user_id % 3 when 0 then 'AFRICA' when 1 then 'ASIA' else 'EUROPE' end as site, event_type as op, cast(ts - interval 9500 day as date) as date, cast(value as {HRS}) as earned_hours from events where event_type = 'click'),
 done as (select l_orderkey as job, cast(max(l_shipdate) as date) as date from lineitem group by 1),
 both_ as (select e.site, e.op, d.date, e.earned_hours from eh e join done d on e.job = d.job where include union all select site, op, date, earned_hours from act)"""


def activity(t):
    site = F.when(F.col("user_id") % 3 == 0, "AFRICA").when(F.col("user_id") % 3 == 1, "ASIA").otherwise("EUROPE")
    # 9,500 days back, where the calendar of the orders lies.
    day = F.to_date(F.col("ts") - F.expr("interval 9500 days"))
    return t.events.filter("event_type = 'click'").select(site.alias("site"), F.col("event_type").alias("op"), day.alias("date"), F.col("value").cast(HRS).alias("earned_hours"))


def completed(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("job")).agg(F.to_date(F.max("l_shipdate")).alias("date"))


@query("op_earned_hours_period", f"""
with {SQL_LINES}, {SQL_EARNED}, {SQL_ACTIVITY}, {SQL_CAL} select site, fiscal_year as year, fiscal_month as month, cast(sum(earned_hours) as double) as earned_hours from both_ join cal on date = calendar_date group by all""")
def op_earned_hours_period(t):
    out = P.earned_by_period(earned(t), completed(t), activity(t), calendar(t), "job", "site")
    return out.withColumn("earned_hours", dbl("earned_hours"))


@query("op_earned_hours_week", f"""
with {SQL_LINES}, {SQL_EARNED}, {SQL_ACTIVITY}, {SQL_CAL} select site, op, fiscal_year, fiscal_week, fiscal_week_start_date, fiscal_week_end_date, cast(sum(earned_hours) as double) as earned_hours
from both_ join cal on date = calendar_date where fiscal_week_end_date < date '1999-06-30' group by all""")
def op_earned_hours_week(t):
    out = P.earned_by_week(earned(t), completed(t), activity(t), calendar(t), "job", "op", "site", AS_OF)
    return out.withColumn("earned_hours", dbl("earned_hours"))


@query("op_earned_hours_detail", f"""
with {SQL_LINES}, {SQL_EARNED}, {SQL_ACTIVITY}
select job, op, site, cast(earned_hours as double) as earned_hours, o_orderpriority as form, cast(o_orderdate as date) as date from eh left join orders on job = o_orderkey
union all select null, op, site, cast(earned_hours as double), null, date from act""")
def op_earned_hours_detail(t):
    hours = earned(t).select("job", "op", "site", "earned_hours")
    attrs = t.orders.select(F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("form"), F.to_date("o_orderdate").alias("date"))
    return P.earned_detail(hours, attrs, activity(t), "job").withColumn("earned_hours", dbl("earned_hours"))


# Worked hours: orders as time sheets, the price as hours, by customer and month.
SQL_WORKED = """ts as (select site as country, site, cast(year(order_date) as integer) as year, cast(month(order_date) as integer) as month, cast(c_custkey as varchar) as employee_id,
   case when c_mktsegment = 'MACHINERY' then 'TEMP' else c_name end as employee_name, c_mktsegment as dept_code,
   sum(case when o_orderpriority <> '1-URGENT' then cast(o_totalprice as decimal(18,2)) * cast(0.001 as decimal(4,3)) else 0 end) as regular_hrs, sum(case when o_orderpriority = '1-URGENT' then cast(o_totalprice as decimal(18,2)) * cast(0.001 as decimal(4,3)) else 0 end) as overtime_hrs,
   sum(cast(o_totalprice as decimal(18,2)) * cast(0.001 as decimal(4,3))) as total_hrs from so group by all),
 ws as (select country, site, year, month, sum(regular_hrs) as worked_regular_hrs, sum(overtime_hrs) as worked_overtime_hrs, sum(total_hrs) as worked_total_hrs from ts group by all)"""


def timesheets(t):
    h = dec("o_totalprice") * F.lit(Decimal("0.001"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    name = F.when(F.col("c_mktsegment") == "MACHINERY", H.TEMP_NAME).otherwise(F.col("c_name"))
    return site_orders(t).groupBy(
        F.col("site").alias("country"), "site", F.year("order_date").alias("year"), F.month("order_date").alias("month"),
        F.col("c_custkey").cast("string").alias("employee_id"), name.alias("employee_name"), F.col("c_mktsegment").alias("dept_code"),
    ).agg(
        F.sum(F.when(~urgent, h).otherwise(F.lit(0))).alias("regular_hrs"), F.sum(F.when(urgent, h).otherwise(F.lit(0))).alias("overtime_hrs"),
        F.sum(h).alias("total_hrs"),
    )


WORKED = ("worked_regular_hrs", "worked_overtime_hrs", "worked_total_hrs")


def worked(t):
    return P.worked_summary(timesheets(t)).withColumns({c: dbl(c) for c in WORKED})


@query("op_worked_hours_summary", f"""
with {SQL_ORDERS}, {SQL_WORKED} select country, site, year, month, {", ".join(f"cast({c} as double) as {c}" for c in WORKED)} from ws""")
def op_worked_hours_summary(t):
    return worked(t)


BANDS = [(s, y, b, round(g + i / 50, 4), p, "hrs") for i, (s, y) in enumerate((s, y) for s in ("AFRICA", "ASIA", "EUROPE") for y in (1997, 1998))
         for b, g, p in ((0.0, 0.0, 0.0), (0.8, 0.05, 1.0), (1.0, 0.1, 1.5), (1.1, 0.2, 2.0))]
TIMING = [(y, m, 1997 if (y, m) <= (1998, 1) else 1998) for y in (1997, 1998) for m in range(1, 13)]
OVERRIDES = [("ASIA", 1997, 3, 9.0), ("AMERICA", 1998, 5, 4.0)]
_vals = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
SQL_PAY = SQL_WORKED + f""", bands(site, year, band_pct, goal_pct, payout_usd, uom) as (values {_vals(BANDS)}), timing(year, month, target_year) as (values {_vals(TIMING)}),
 over_(site, year, month, payout_usd) as (values {_vals(OVERRIDES)}),
 earn as (select site, cast(year(promise_date) as integer) as year, cast(month(promise_date) as integer) as month, cast(sum(cast(l_quantity as decimal(18,2))) as double) as earned_hours from ln where l_returnflag = 'A' group by all),
 prod as (select w.country, w.site, w.year, w.month, {", ".join(f"cast({c} as double) as {c}" for c in WORKED)}, coalesce(earned_hours, 0) as earned_hours, coalesce(earned_hours, 0) / nullif(cast(worked_total_hrs as double), 0) as productivity_pct, target_year
   from ws w left join earn e on w.site = e.site and w.year = e.year and w.month = e.month left join timing t on w.year = t.year and w.month = t.month),
 pay as (
   select p.* exclude (target_year), target_year,
     (select cast(max(b.band_pct) as double) from bands b where b.site = p.site and b.year = p.target_year and b.goal_pct <= p.productivity_pct) as band_pct,
     coalesce((select cast(o.payout_usd as double) from over_ o where o.site = p.site and o.year = p.year and o.month = p.month),
       (select cast(arg_max(b.payout_usd, b.band_pct) as double) from bands b where b.site = p.site and b.year = p.target_year and b.goal_pct <= p.productivity_pct)) as payout_usd,
     (select arg_max(b.uom, b.band_pct) from bands b where b.site = p.site and b.year = p.target_year and b.goal_pct <= p.productivity_pct) as uom,
     (select cast(b.goal_pct as double) from bands b where b.site = p.site and b.year = p.target_year and b.band_pct = 1) as target_pct
   from prod p)"""


def bands(t):
    return reference_table(t.spark, BANDS, "site string, year int, band_pct double, goal_pct double, payout_usd double, uom string")


def payouts(t):
    got = site_lines(t).filter("l_returnflag = 'A'").groupBy("site", F.year("promise_date").alias("year"), F.month("promise_date").alias("month")).agg(
        dbl(F.sum(dec("l_quantity"))).alias("earned_hours")
    )
    timing = reference_table(t.spark, TIMING, "year int, month int, target_year int")
    fixed = reference_table(t.spark, OVERRIDES, "site string, year int, month int, payout_usd double")
    return P.banded_payout(worked(t), got, timing, bands(t), fixed)


@query("op_banded_payout", f"with {SQL_LINES}, {SQL_PAY} select * from pay")
def op_banded_payout(t):
    return payouts(t)


@query("op_employee_payout", f"""
with {SQL_LINES}, {SQL_PAY}
select ts.site, ts.year, ts.month, employee_id, employee_name, cast(total_hrs as double) as total_hrs, payout_usd, case when employee_name = 'TEMP' then 0 else cast(total_hrs as double) * coalesce(payout_usd, 0) end as month_bonus
from ts left join pay on ts.site = pay.site and ts.year = pay.year and ts.month = pay.month""")
def op_employee_payout(t):
    sheets = timesheets(t).select("site", "year", "month", "employee_id", "employee_name", dbl("total_hrs").alias("total_hrs"))
    out = P.employee_payout(sheets, payouts(t))
    return out.withColumn("month_bonus", dbl("month_bonus"))


@query("op_period_extract", f"""
with {SQL_LINES}, {SQL_PAY} select 'result' as part, site, year, month, productivity_pct as value from pay where target_year = (select target_year from pay where year = 1998 and month = 6 limit 1)
union all select 'target', site, cast(year as integer), null, cast(goal_pct as double) from bands where year = 1998 and band_pct <> 0
union all select 'detail', site, year, month, cast(total_hrs as double) from ts where year = 1998 and month = 6""")
def op_period_extract(t):
    results = P.period_results(payouts(t), 1998, 6).select(F.lit("result").alias("part"), "site", "year", "month", F.col("productivity_pct").alias("value"))
    targets = P.period_targets(bands(t), 1998).select(F.lit("target").alias("part"), "site", "year", F.lit(None).cast("int").alias("month"), F.col("goal_pct").alias("value"))
    detail = P.period_detail(timesheets(t), 1998, 6, ["site", "year", "month", dbl("total_hrs").alias("value")]).withColumn("part", F.lit("detail"))
    return results.unionByName(targets).unionByName(detail)


# Six payroll feeds shaped from the given tables.
SQL_FEEDS = SQL_SITES + """, sitemap as (select n_name as site_name, n_nationkey, site, 'C' || n_nationkey as country from ns where n_nationkey < 20),
 f1 as (select country, m.site, cast(year(ts) as integer) as year, cast(month(ts) as integer) as month, cast(user_id as varchar) as employee_id, 'NAME ' || (user_id % 7) as employee_name, '110/120' as dept_code,
   sum(case when event_type = 'click' then cast(value as decimal(18,2)) else 0 end) as r, sum(case when event_type in ('view', 'purchase') then cast(value as decimal(18,2)) else 0 end) as o
   from events join sitemap m on n_nationkey = user_id % 25 group by all),
 f2 as (select 'US' as country, 'AMERICA' as site, 1998 as year, cast(month(o_orderdate) as integer) as month, '999999' as employee_id, 'TEMP' as employee_name, '110/120' as dept_code,
   sum(case when o_orderstatus = 'F' then cast(o_totalprice as decimal(18,2)) else 0 end) as r, sum(case when o_orderstatus = 'P' then cast(o_totalprice as decimal(18,2)) else 0 end) as o from orders group by all),
 f3 as (select 'SG' as country, 'ASIA' as site, 1998 as year, cast(month(o_orderdate) as integer) as month, cast(c_custkey as varchar) as employee_id, c_name as employee_name, '120' as dept_code,
   sum(cast(o_totalprice as decimal(18,2))) as r, sum(cast(o_totalprice as decimal(18,0))) as o from orders join customer on o_custkey = c_custkey where c_nationkey <= 3 group by all),
 f4 as (select 'FR' as country, case c_nationkey when 5 then 'S5' when 6 then 'S6' end as site, cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month, cast(c_custkey as varchar) as employee_id, c_name as employee_name,
   case c_mktsegment when 'BUILDING' then '120' when 'MACHINERY' then '121' else '300' end as dept_code, sum(cast(o_totalprice as decimal(18,2))) as t, sum(case when o_orderstatus = 'P' then cast(o_totalprice as decimal(18,2)) else 0 end) as o
   from orders join customer on o_custkey = c_custkey where c_nationkey between 4 and 17 group by all),
 f5 as (select country, site, cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month, c_custkey || ' - ' || case when o_orderpriority = '1-URGENT' then 'PIP' else 'NONE' end as employee_id, c_name as employee_name, 'D' || c_nationkey as dept_code,
   case when c_mktsegment = 'BUILDING' then 'Plant - Processing' else 'Office' end as department, case when o_orderpriority = '1-URGENT' then 'PIP' else 'NONE' end as plan, cast(o_totalprice as decimal(18,2)) as t, cast(case when o_orderstatus = 'P' then o_totalprice else 0 end as decimal(18,2)) as o
   from orders join customer on o_custkey = c_custkey left join sitemap m on m.n_nationkey = c_nationkey where c_nationkey >= 18),
 f6 as (select 'CN' as country, m.site, 1998 as year, cast(month(o_orderdate) as integer) as month, cast(c_custkey as varchar) as employee_id, c_name as employee_name, '120' as dept_code,
   sum(cast(o_totalprice as decimal(18,2))) as r, sum(cast(o_totalprice as decimal(18,0))) as o
   from orders join customer on o_custkey = c_custkey left join sitemap m on m.n_nationkey = c_nationkey where c_mktsegment = 'BUILDING' group by all),
 allf as (select country, site, year, month, employee_id, employee_name, dept_code, cast(r as double) as regular_hrs, cast(o as double) as overtime_hrs, cast(r as double) + cast(o as double) as total_hrs from f1
   union all select country, site, year, month, employee_id, employee_name, dept_code, cast(r as double), cast(o as double), cast(r as double) + cast(o as double) from f2
   union all select country, site, year, month, employee_id, employee_name, dept_code, cast(r as double), cast(o as double), cast(r as double) + cast(o as double) from f3
   union all select country, site, year, month, employee_id, employee_name, dept_code, cast(r as double), cast(o as double), cast(r as double) + cast(o as double) from f6
   union all select country, site, year, month, employee_id, employee_name, dept_code, cast(t as double) - cast(o as double), cast(o as double), cast(t as double) from f4 where dept_code in ('120', '121')
   union all select country, site, year, month, employee_id, employee_name, dept_code, cast(t as double) - cast(o as double), cast(o as double), cast(t as double) from f5 where case when year < 1998 then department = 'Plant - Processing' else plan = 'PIP' end)"""


def feeds(t):
    text = lambda c: c.cast("string")
    sites = nation_sites(t).filter("n_nationkey < 20").select(
        F.col("n_name").alias("site_name"), "site", F.concat(F.lit("C"), text(F.col("n_nationkey"))).alias("country")
    )
    nations = t.nation.select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name")
    code = F.when(F.col("event_type") == "click", "Regular").when(F.col("event_type") == "view", "Overtime").when(F.col("event_type") == "purchase", "Doubletime").otherwise("Absent")
    raw1 = t.events.join(nations, F.col("user_id") % 25 == F.col("k")).select(
        F.concat(F.lit("grp/co/"), "n_name", F.lit("/dept")).alias("location"), code.alias("pay_code"),
        F.concat(F.lit("NAME "), text(F.col("user_id") % 7), F.lit(" ("), text(F.col("user_id")), F.lit(")")).alias("employee"),
        text(dec("value")).alias("hours"), F.year("ts").alias("year"), F.month("ts").alias("month"),
    )
    m, w = F.month("o_orderdate"), F.least(F.floor((F.dayofmonth("o_orderdate") - 1) / 7) + 1, F.lit(5))
    weeks = [text(F.sum(F.when((m == n) & (w == k), dec("o_totalprice")))).alias(f"W{k}-{name}") for name, n in MONTH_NUMBER.items() for k in range(1, 6)]
    raw2 = t.orders.groupBy(F.col("o_orderstatus").alias("label")).agg(*weeks)
    who = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", "c_mktsegment")
    raw3 = month_sheet(t).join(who, "o_custkey").select(
        F.concat(text(F.col("o_custkey")), F.lit(".0")).alias("number"), "c_name",
        F.concat(F.when(F.col("c_nationkey") <= 3, "120").otherwise("300"), F.lit(" plant")).alias("dept"), *MONTHS, *[f"`{x}.1`" for x in MONTHS],
    )
    place = nations.join(sites, F.col("n_name") == F.col("site_name"), "left").select("k", "site")
    raw6 = month_sheet(t).join(who, "o_custkey").join(place, F.col("c_nationkey") == F.col("k")).select(
        F.concat(text(F.col("o_custkey")), F.lit(".0")).alias("number"), "c_name", "site",
        F.when(F.col("c_mktsegment") == "BUILDING", H.PLAN_DEPT).otherwise("Office").alias("dept"), *MONTHS, *[f"`{x}.1`" for x in MONTHS],
    )
    sheet = t.orders.join(who, "o_custkey")
    late = F.when(F.col("o_orderstatus") == "P", dec("o_totalprice")).otherwise(F.lit(0))
    dept = F.when(F.col("c_mktsegment") == "BUILDING", "120").when(F.col("c_mktsegment") == "MACHINERY", "121").otherwise("300")
    raw4 = sheet.filter("c_nationkey between 4 and 17").groupBy(
        text(F.col("c_nationkey")).alias("branch"), text(F.year("o_orderdate")).alias("year"), text(F.month("o_orderdate")).alias("month"),
        text(F.col("o_custkey")).alias("employee_id"), F.col("c_name").alias("employee_name"), dept.alias("dept_code"),
    ).agg(text(F.sum(dec("o_totalprice"))).alias("worked"), text(F.sum(late)).alias("overtime"))
    raw5 = sheet.filter("c_nationkey >= 18").join(nations, F.col("c_nationkey") == F.col("k")).select(
        text(F.to_date("o_orderdate")).alias("month"), F.col("n_name").alias("location"), F.col("c_name").alias("employee_name"),
        F.concat(text(F.col("o_custkey")), F.lit(".0")).alias("employee_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "PIP").otherwise("NONE").alias("plan"),
        F.when(F.col("c_mktsegment") == "BUILDING", H.PLAN_DEPT).otherwise("Office").alias("department"), F.concat(F.lit("D"), text(F.col("c_nationkey"))).alias("dept_code"),
        text(dec("o_totalprice")).alias("worked"), text(late).alias("overtime"),
    )
    return [
        H.pay_code_feed(raw1, sites, "decimal(18,2)"), H.temp_feed(raw2, "label", "F", "P", 1998, "US", "AMERICA", "decimal(18,2)"),
        H.wide_feed(raw3, {"number": "employee_id", "c_name": "employee_name", "dept": "dept_code"}, 1998, "SG", F.lit("ASIA")),
        H.branch_feed(raw4, "FR", {5: "S5", 6: "S6"}), H.plan_feed(raw5, sites, since=1998),
        H.wide_feed(raw6, {"number": "employee_id", "c_name": "employee_name", "dept": "dept_code"}, 1998, "CN", F.col("site"), department=H.PLAN_DEPT),
    ]


@query("op_worked_hours_standardise", f"with {SQL_FEEDS} select * from allf where total_hrs <> 0")
def op_worked_hours_standardise(t):
    return H.standardise(feeds(t))
