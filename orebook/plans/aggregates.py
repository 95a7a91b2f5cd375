"""Aggregations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebook.functions.dates import MONTHS, MONTH_NUMBER
from orebook.functions.numbers import ratio
from orebook.operators import rollup as R
from orebook.operators import yields as Y
from orebook.plans.registry import query
from orebook.session import cut
from orebook.plans.shapes import PRICE, SITES, SQL_LINES, SQL_ORDERS, dbl, dec, site_lines, site_orders

D2 = "decimal(18,2)"


def sum_dbl(c, cond=None):
    x = dec(c)
    return F.sum(x if cond is None else F.when(cond, x)).cast("double")


@query("agg_grain_rollup", """
select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(cast(l_shipdate as date)) as ship_date,
       max(l_discount) as l_discount, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity,
       cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as revenue
from lineitem group by 1, 2""")
def agg_grain_rollup(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("ship_date"), "l_discount",
                           dec("l_quantity").alias("quantity"), dec("l_extendedprice", PRICE).alias("revenue"))
    out = R.grain_rollup(li, ["l_orderkey", "l_linenumber"], first=["l_partkey", "ship_date"], last=["l_discount"],
                         sums=["quantity", "revenue"])
    return out.withColumns({"quantity": dbl("quantity"), "revenue": dbl("revenue")})


@query("agg_sum_sign_normalised", """
select l_orderkey, l_partkey, cast(sum(-cast(-l_quantity as decimal(18,2))) as double) as picked from lineitem group by 1, 2""")
def agg_sum_sign_normalised(t):
    booked = (-F.col("l_quantity")).cast(D2)
    return t.lineitem.groupBy("l_orderkey", "l_partkey").agg(dbl(F.sum(-booked)).alias("picked"))


@query("agg_ratio_of_sums", """
select l_suppkey, sum(cast(l_quantity as decimal(18,2)))::double / nullif(sum(cast(l_tax as decimal(18,2)))::double, 0) as by_sums,
       max(l_quantity) / nullif(max(l_tax), 0) as by_maxima from lineitem group by 1""")
def agg_ratio_of_sums(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        ratio(sum_dbl("l_quantity"), sum_dbl("l_tax")).alias("by_sums"), ratio(F.max("l_quantity"), F.max("l_tax")).alias("by_maxima")
    )


@query("agg_count_distinct_cond", """
select l_suppkey, count(distinct l_partkey) as items, count(distinct case when l_returnflag = 'R' then l_partkey end) as returned_items
from lineitem group by 1""")
def agg_count_distinct_cond(t):
    return R.count_distinct_by(t.lineitem, ["l_suppkey"], "l_partkey", "items", {"returned_items": F.col("l_returnflag") == "R"})


@query("agg_distinct_grains", """
select site, cast(case when grouping(ship_year) = 1 then null else ship_year end as integer) as ship_year, grouping(ship_year) = 1 as all_years,
  count(distinct l_partkey) as items, count(distinct l_partkey) filter (where l_returnflag = 'R') as returned_items, count(distinct l_partkey) filter (where l_linestatus = 'O') as open_items
from (select 'S' || (l_suppkey % 7) as site, year(l_shipdate) as ship_year, l_partkey, l_returnflag, l_linestatus from lineitem) group by rollup(site, ship_year) having site is not null""")
def agg_distinct_grains(t):
    """Distinct items by site and year and, from the same bitmaps, by site."""
    site = F.concat(F.lit("S"), (F.col("l_suppkey") % 7).cast("string"))
    kinds = {"items": F.lit(True), "returned_items": F.col("l_returnflag") == "R", "open_items": F.col("l_linestatus") == "O"}
    rows = t.lineitem.withColumns({"site": site, "ship_year": F.year("l_shipdate")})
    maps = cut(R.distinct_bitmaps(rows, ["site", "ship_year"], "l_partkey", kinds), "item-bitmaps")
    by_year = R.count_bitmaps(maps, ["site", "ship_year"], list(kinds)).withColumn("all_years", F.lit(False))
    return R.stack([by_year, R.count_bitmaps(maps, ["site"], list(kinds)).withColumn("all_years", F.lit(True))])


@query("agg_json_array_segments", f"""
select l_suppkey, (place - 1) // 25 as segment, count(*) as n, cast(to_json(list({{'date': strftime(l_shipdate, '%Y-%m-%d'), 'site': l_returnflag, 'part': l_partkey}} order by place)) as varchar) as details
from (select *, row_number() over (partition by l_suppkey order by {", ".join(["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"])}) as place from lineitem) group by 1, 2""")
def agg_json_array_segments(t):
    """Lists of any length as numbered segments of at most 25 rows."""
    ship = F.col("l_shipdate")
    order = [ship.asc_nulls_last(), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]]
    fields = [F.date_format(ship, "yyyy-MM-dd").alias("date"), F.col("l_returnflag").alias("site"), F.col("l_partkey").alias("part")]
    out = R.list_segments(t.lineitem, ["l_suppkey"], order, [F.to_date(ship), F.shiftright("l_orderkey", 20)], fields, 25)
    return out.select("l_suppkey", "segment", "n", F.to_json("items").alias("details"))


@query("agg_conditional", """
select l_partkey, count(case when l_returnflag = 'R' then 1 end) as returned, count(case when l_returnflag = 'A' then 1 end) as accepted,
       cast(sum(case when l_linestatus = 'O' then cast(l_quantity as decimal(18,2)) else 0 end) as double) as open_qty from lineitem group by 1""")
def agg_conditional(t):
    flag = F.col("l_returnflag")
    return t.lineitem.groupBy("l_partkey").agg(
        F.count_if(flag == "R").alias("returned"), F.count_if(flag == "A").alias("accepted"),
        dbl(F.sum(F.when(F.col("l_linestatus") == "O", dec("l_quantity")).otherwise(F.lit(0)))).alias("open_qty"),
    )


@query("agg_filter_clause", """
select l_orderkey, max(l_partkey) filter (where l_discount > 0.05) as discounted_part, max(l_linestatus) filter (where l_tax = 0) as taxfree_status
from lineitem group by 1""")
def agg_filter_clause(t):
    return t.lineitem.groupBy("l_orderkey").agg(
        F.expr("max(l_partkey) filter (where l_discount > 0.05D)").alias("discounted_part"),
        F.expr("max(l_linestatus) filter (where l_tax = 0)").alias("taxfree_status"),
    )


@query("agg_bool_or", """
select o_custkey, bool_or(o_orderstatus = 'P') as any_pending, bool_or(nullif(o_orderstatus, 'F') = 'O') as any_open from orders group by 1""")
def agg_bool_or(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_custkey").agg(F.bool_or(s == "P").alias("any_pending"), F.bool_or(F.nullif(s, F.lit("F")) == "O").alias("any_open"))


@query("agg_string_ordered", """
select l_orderkey, string_agg(l_returnflag, ' → ' order by l_linenumber, l_returnflag) as route
from (select distinct l_orderkey, l_linenumber, nullif(l_returnflag, 'A') as l_returnflag from lineitem) group by 1""")
def agg_string_ordered(t):
    steps = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif(F.col("l_returnflag"), F.lit("A")).alias("l_returnflag")).distinct()
    return steps.groupBy("l_orderkey").agg(R.ordered_text("l_returnflag", ["l_linenumber", "l_returnflag"], " → ").alias("route"))


@query("agg_string_distinct", """
select l_orderkey, string_agg(x, ', ' order by x) as items from (select distinct l_orderkey, cast(l_partkey as varchar) as x from lineitem) group by 1""")
def agg_string_distinct(t):
    return R.distinct_text(t.lineitem.withColumn("x", F.col("l_partkey").cast("string")), ["l_orderkey"], "x", ", ", "items")


@query("agg_json_array_ordered", """
select l_orderkey, cast(to_json(list({'date': strftime(l_shipdate, '%Y-%m-%d'), 'site': l_returnflag, 'part': l_partkey}
  order by l_shipdate, l_linenumber, l_partkey, l_suppkey)) as varchar) as details from lineitem group by 1""")
def agg_json_array_ordered(t):
    ship = F.col("l_shipdate")
    details = R.json_list(
        [*R.null_last_key(ship), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")],
        [F.date_format(ship, "yyyy-MM-dd").alias("date"), F.col("l_returnflag").alias("site"), F.col("l_partkey").alias("part")],
    )
    return t.lineitem.groupBy("l_orderkey").agg(F.to_json(details).alias("details"))


SQL_PIVOT = ", ".join(f"coalesce(cast(sum(case when site = '{s}' then cast(o_totalprice as decimal(18,2)) end) as double), 0) as {s.lower()}" for s in SITES)


@query("agg_pivot_fixed", f"""
with {SQL_ORDERS} select c_mktsegment, {SQL_PIVOT} from so group by 1""")
def agg_pivot_fixed(t):
    out = R.pivot_fixed(site_orders(t), ["c_mktsegment"], "site", {s: s.lower() for s in SITES}, dec("o_totalprice"))
    return out.select("c_mktsegment", *[dbl(s.lower()).alias(s.lower()) for s in SITES])


@query("agg_pivot_slots", """
with r as (select l_orderkey, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rn from lineitem)
select l_orderkey, max(case when rn = 1 then l_partkey end) as l_partkey_1, max(case when rn = 1 then l_suppkey end) as l_suppkey_1,
  max(case when rn = 2 then l_partkey end) as l_partkey_2, max(case when rn = 2 then l_suppkey end) as l_suppkey_2,
  max(case when rn = 3 then l_partkey end) as l_partkey_3, max(case when rn = 3 then l_suppkey end) as l_suppkey_3 from r group by 1""")
def agg_pivot_slots(t):
    return R.slots(t.lineitem, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")], ["l_partkey", "l_suppkey"], 3)


@query("agg_pivot_margins", f"""
with {SQL_ORDERS}, x as (select site, o_orderstatus, cast(o_totalprice as decimal(18,2)) as v from so)
select coalesce(site, 'Total') as site, coalesce(cast(sum(case when o_orderstatus = 'O' then v end) as double), 0) as "O", coalesce(cast(sum(case when o_orderstatus = 'P' then v end) as double), 0) as "P",
  coalesce(cast(sum(case when o_orderstatus = 'F' then v end) as double), 0) as "F", cast(sum(v) as double) as "Total" from x group by rollup(site)""")
def agg_pivot_margins(t):
    out = R.pivot_margins(site_orders(t), "site", "o_orderstatus", ["O", "P", "F"], dec("o_totalprice"))
    return out.select("site", *[dbl(c).alias(c) for c in ("O", "P", "F", "Total")])


@query("agg_pivot_codes", """
with x as (select user_id, event_type, cast(value as decimal(18,2)) as v from events)
select user_id, coalesce(cast(sum(case when event_type = 'click' then v end) as double), 0) as regular_hrs,
  coalesce(cast(sum(case when event_type in ('view', 'absent') then v end) as double), 0) as overtime_hrs from x group by 1""")
def agg_pivot_codes(t):
    codes = {"click": "regular_hrs", "view": "overtime_hrs", "absent": "double_hrs"}
    out = R.pivot_fixed(t.events, ["user_id"], "event_type", codes, dec("value"))
    return out.select("user_id", dbl("regular_hrs").alias("regular_hrs"), dbl(F.col("overtime_hrs") + F.col("double_hrs")).alias("overtime_hrs"))


@query("agg_multi_level", """
select l_returnflag, l_linestatus, cast(l_shipdate as date) as ship_date, l_discount > 0.05 as discounted,
  cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as usd
from lineitem group by 1, 2, 3, 4""")
def agg_multi_level(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("ship_date"),
                             (F.col("l_discount") > 0.05).alias("discounted"), dec("l_quantity").alias("qty"), dec("l_extendedprice").alias("usd"))
    out = Y.sum_measures(rows, ["l_returnflag", "l_linestatus", "ship_date", "discounted"], ["qty", "usd"])
    return out.withColumns({"qty": dbl("qty"), "usd": dbl("usd")})


@query("agg_distinct_rows", """
select distinct o_custkey, o_orderstatus, cast(o_orderdate as date) as order_date from orders""")
def agg_distinct_rows(t):
    return t.orders.select("o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("order_date")).distinct()


@query("agg_global_min_max", "select cast(min(o_orderdate) as date) as lo, cast(max(o_orderdate) as date) as hi from orders")
def agg_global_min_max(t):
    return t.orders.agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))


# Reshape: orders pivoted into month columns stand for the payroll sheets.

def month_sheet(t):
    """Per customer twelve month columns of price and twelve of count, the shape of a yearly sheet."""
    m = F.month("o_orderdate")
    aggs = [F.sum(F.when(m == n, dec("o_totalprice"))).cast("string").alias(name) for name, n in MONTH_NUMBER.items()]
    aggs += [F.sum(F.when(m == n, dec("o_totalprice", "decimal(18,0)"))).cast("string").alias(f"{name}.1") for name, n in MONTH_NUMBER.items()]
    return t.orders.groupBy("o_custkey").agg(*aggs)


SQL_MONTHS = """months as (select c_custkey as o_custkey, unnest(range(1, 13)) as month from customer where c_custkey in (select o_custkey from orders)),
 v as (select o_custkey, month(o_orderdate) as month, sum(cast(o_totalprice as decimal(18,2))) as a, sum(cast(o_totalprice as decimal(18,0))) as b from orders group by 1, 2)"""


@query("rs_melt_months", f"""
with {SQL_MONTHS}
select m.o_custkey, cast(m.month as integer) as month, coalesce(cast(a as double), 0) as hours from months m left join v on m.o_custkey = v.o_custkey and m.month = v.month""")
def rs_melt_months(t):
    from orebook.functions.numbers import coerce
    from orebook.functions.text import lookup

    sheet = month_sheet(t).select("o_custkey", *MONTHS)
    long = sheet.unpivot(["o_custkey"], list(MONTHS), "month_label", "hours")
    return long.select("o_custkey", lookup(F.col("month_label"), MONTH_NUMBER).alias("month"), coerce(F.col("hours")).alias("hours"))


@query("rs_melt_pair_merge", f"""
with {SQL_MONTHS}
select m.o_custkey, cast(m.month as integer) as month, coalesce(cast(a as double), 0) as regular, coalesce(cast(b as double), 0) as overtime,
  coalesce(cast(a as double), 0) + coalesce(cast(b as double), 0) as total from months m left join v on m.o_custkey = v.o_custkey and m.month = v.month""")
def rs_melt_pair_merge(t):
    from orebook.functions.numbers import coerce

    long = R.melt_pairs(month_sheet(t), ["o_custkey"], {n: m for m, n in MONTH_NUMBER.items()},
                        {n: f"{m}.1" for m, n in MONTH_NUMBER.items()}, "reg", "ot")
    a, b = coerce(F.col("reg")), coerce(F.col("ot"))
    return long.select("o_custkey", "month", a.alias("regular"), b.alias("overtime"), (a + b).alias("total"))


@query("rs_transpose_rows", """
select month(o_orderdate)::integer as month, cast(sum(case when o_orderstatus = 'F' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as regular_hrs,
  cast(sum(case when o_orderstatus = 'P' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as overtime_hrs from orders group by 1""")
def rs_transpose_rows(t):
    """Two labelled rows by ``W<n>-<Mon>`` columns turned into one row per month."""
    from orebook.functions.text import lookup

    m, w = F.month("o_orderdate"), F.least(F.floor((F.dayofmonth("o_orderdate") - 1) / 7) + 1, F.lit(5))
    cols = [F.coalesce(F.sum(F.when((m == n) & (w == k), dec("o_totalprice"))), F.lit(0)).alias(f"W{k}-{name}")
            for name, n in MONTH_NUMBER.items() for k in range(1, 6)]
    sheet = t.orders.filter("o_orderstatus in ('F', 'P')").groupBy("o_orderstatus").agg(*cols)
    long = sheet.unpivot(["o_orderstatus"], [c for c in sheet.columns if c != "o_orderstatus"], "period", "hours")
    month = lookup(F.split("period", "-").getItem(1), MONTH_NUMBER)
    zero = F.lit(0)
    return long.groupBy(month.alias("month")).agg(
        dbl(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("hours")).otherwise(zero))).alias("regular_hrs"),
        dbl(F.sum(F.when(F.col("o_orderstatus") == "P", F.col("hours")).otherwise(zero))).alias("overtime_hrs"),
    )
