"""Projection, cleaning and typing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from orebook.functions import clean as C
from orebook.functions import dates as D
from orebook.functions import numbers as N
from orebook.operators.allocation import pipeline_status
from orebook.plans.registry import query
from orebook.plans.shapes import AS_OF, SQL_LIFE, SQL_LINES, SQL_ORDERS, SQL_SITES, dbl, dec, order_life, site_lines, site_orders, customer_sites

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("proj_clean_spec", """
select c_custkey as customer_id, lower(trim(c_name)) as customer_name, trim(c_mktsegment) as segment,
       cast(cast(c_acctbal as decimal(18,2)) as double) as balance
from customer where c_custkey is not null""")
def proj_clean_spec(t):
    specs = [
        C.ColumnSpec("c_custkey", "customer_id", "bigint"), C.ColumnSpec("c_name", "customer_name", lower=True),
        C.ColumnSpec("c_mktsegment", "segment"), C.ColumnSpec("c_acctbal", "balance", "decimal(18,2)"),
    ]
    return C.clean(t.customer, specs, ["customer_id"]).withColumn("balance", dbl("balance"))


@query("proj_sentinel_date", """
with raw as (
  select o_orderkey,
         case o_orderstatus when 'P' then date '1900-01-01' when 'O' then date '1970-01-01' else cast(o_orderdate as date) end as d,
         case o_orderstatus when 'P' then '0-00-00' else strftime(o_orderdate, '%Y-%m-%d') end as x
  from orders)
select o_orderkey, case when d in (date '1900-01-01', date '1970-01-01') then null else d end as done_date,
       try_cast(nullif(x, '0-00-00') as date) as action_date from raw""")
def proj_sentinel_date(t):
    status = F.col("o_orderstatus")
    d = F.when(status == "P", F.lit(dt.date(1900, 1, 1))).when(status == "O", F.lit(dt.date(1970, 1, 1))).otherwise(F.to_date("o_orderdate"))
    x = F.when(status == "P", "0-00-00").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", C.no_date_to_null(d).alias("done_date"), C.no_date_text_to_null(x).alias("action_date"))


@query("proj_blank_to_null_cast", """
select doc_id, cast(try_cast(nullif(trim(regexp_extract(text, '[0-9]+', 0)), '') as decimal(38,2)) as double) as first_number
from documents""")
def proj_blank_to_null_cast(t):
    found = F.regexp_extract("text", "[0-9]+", 0)
    # A run of more than 36 digits is beyond the type and gives null.
    return t.documents.select("doc_id", dbl(C.blank_to_null_cast(found, "decimal(38,2)", lenient=True)).alias("first_number"))


@query("proj_ratio_guard", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case when abs(l_discount) < 0.01 then null else l_tax / l_discount end as tax_share from lineitem""")
def proj_ratio_guard(t):
    share = N.ratio(F.col("l_tax"), F.col("l_discount"))
    return t.lineitem.select(*LINE_KEY, N.ratio_guard(share, F.col("l_discount")).alias("tax_share"))


@query("proj_constant_tag", """
select c_custkey as party_id, c_name as party_name, 'customer' as company, c_mktsegment as segment from customer
union all
select s_suppkey, s_name, 'supplier', cast(null as varchar) from supplier""")
def proj_constant_tag(t):
    a = t.customer.select(F.col("c_custkey").alias("party_id"), F.col("c_name").alias("party_name"),
                          F.lit("customer").alias("company"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("party_id"), F.col("s_name").alias("party_name"),
                          F.lit("supplier").alias("company"), F.lit(None).cast("string").alias("segment"))
    return a.unionByName(b)


UOM = """case when l_returnflag = 'R' then 'LBS' when l_returnflag = 'A' then 'MT'
  when l_linestatus = 'O' then 'KGS' else 'FT' end"""


def _uom():
    return (F.when(F.col("l_returnflag") == "R", "LBS").when(F.col("l_returnflag") == "A", "MT")
            .when(F.col("l_linestatus") == "O", "KGS").otherwise("FT"))


@query("proj_uom_convert", f"""
with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as q, nullif(l_tax, 0) as w, {UOM} as uom from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, uom,
       case uom when 'LBS' then coalesce(q, 0) when 'MT' then coalesce(q, 0) * coalesce(w, 0) * cast(2.2046 as double)
            when 'KGS' then coalesce(q, 0) * cast(2.2046 as double) else coalesce(q, 0) * coalesce(w, 0) end as lbs from x""")
def proj_uom_convert(t):
    lbs = N.to_lbs(F.col("l_quantity"), F.col("uom"), F.nullif(F.col("l_tax"), F.lit(0)))
    return t.lineitem.withColumn("uom", _uom()).select(*LINE_KEY, "uom", lbs.alias("lbs"))


@query("proj_native_uom_qty", """
with x as (select *, (case l_linenumber when 1 then 'PCS' when 2 then 'FOOT' when 3 then 'INCH' when 4 then 'KGS'
             when 5 then 'POUNDS' end) as unit, l_quantity * 12 as pcs, l_linenumber - 1 + l_discount * 100 as len,
             round(l_quantity * cast(2.20462262184878 as double), 6) as lbs from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, unit,
       case unit when 'PCS' then round(pcs / nullif(len, 0), 0) when 'FOOT' then pcs / cast(12 as double) when 'INCH' then pcs
            when 'KGS' then l_quantity when 'POUNDS' then lbs end as on_hand_qty from x""")
def proj_native_uom_qty(t):
    unit = (F.when(F.col("l_linenumber") == 1, "PCS").when(F.col("l_linenumber") == 2, "FOOT").when(F.col("l_linenumber") == 3, "INCH")
            .when(F.col("l_linenumber") == 4, "KGS").when(F.col("l_linenumber") == 5, "POUNDS"))
    x = t.lineitem.withColumns({"unit": unit, "pcs": F.col("l_quantity") * 12,
                                "len": F.col("l_linenumber") - 1 + F.col("l_discount") * 100})
    qty = N.native_qty(F.col("unit"), F.col("pcs"), F.col("len"), F.col("l_quantity"), N.kg_to_lb(F.col("l_quantity")))
    return x.select(*LINE_KEY, "unit", qty.alias("on_hand_qty"))


@query("proj_currency_from_site", f"""
with {SQL_SITES}
select c_custkey, site, case when site in ('EUROPE') then 'EUR' when site in ('AMERICA', 'ASIA') then 'MXN' else 'USD' end as currency
from customer join ns on c_nationkey = n_nationkey""")
def proj_currency_from_site(t):
    currency = N.currency_of_site(F.col("site"), {"EUR": ["EUROPE"], "MXN": ["AMERICA", "ASIA"]}, "USD")
    return customer_sites(t).select("c_custkey", "site", currency.alias("currency"))


@query("proj_status_case", """
with x as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority <> '5-LOW' as in_scope,
         case o_orderstatus when 'F' then 'Complete,Closed' when 'P' then 'Released' else 'Complete' end as job_status,
         case when l_returnflag = 'R' then 0 when l_linenumber = 7 then null else l_quantity end as req, l_discount > 0.05 as short
  from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case when not in_scope then null
            when req = 0 and regexp_full_match(job_status, '(Complete|Closed)(,(Complete|Closed))*') then 'Job Complete'
            when req = 0 then 'Job Started' when short then 'No Material' when req > 0 then 'Material Available'
            else 'Unknown' end as status from x""")
def proj_status_case(t):
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    job = F.when(F.col("o_orderstatus") == "F", "Complete,Closed").when(F.col("o_orderstatus") == "P", "Released").otherwise("Complete")
    req = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_quantity"))
    status = pipeline_status(F.col("o_orderpriority") != "5-LOW", req, job, F.col("l_discount") > 0.05)
    return x.select(*LINE_KEY, status.alias("status"))


@query("proj_requirement_priority", """
with x as (
  select l.*, case when l_returnflag = 'R' then l_quantity else 0 end as issued,
         case when l_returnflag = 'A' and l_linestatus = 'F' then 'L' || l_suppkey end as lots,
         case when l_linenumber > 4 then l_quantity * 2 end as expected,
         case p_type when 'ECONOMY' then 'BAR' when 'LARGE' then 'PLATE' when 'MEDIUM' then 'TUBE' when 'PROMO' then 'EXTRUSION' else 'WIRE' end as form,
         case l_linenumber when 1 then 'lbs' when 2 then 'Ft' when 3 then 'in' else 'EA' end as uom
  from lineitem l left join part on l_partkey = p_partkey)
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case when issued > 0 then 0 when lots is not null then 0 when expected is not null then expected
            when form in ('BAR', 'STRUCTURAL', 'PLATE', 'SHEET') then case when upper(uom) = 'LBS' then l_quantity else l_extendedprice end
            when form in ('TUBE', 'EXTRUSION') then
              case when upper(uom) = 'FT' then l_quantity when upper(uom) = 'IN' then l_quantity / cast(12 as double)
                   else l_quantity * l_tax / cast(12 as double) end
       end as required from x""")
def proj_requirement_priority(t):
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    form = (F.when(F.col("p_type") == "ECONOMY", "BAR").when(F.col("p_type") == "LARGE", "PLATE")
            .when(F.col("p_type") == "MEDIUM", "TUBE").when(F.col("p_type") == "PROMO", "EXTRUSION").otherwise("WIRE"))
    uom = F.when(F.col("l_linenumber") == 1, "lbs").when(F.col("l_linenumber") == 2, "Ft").when(F.col("l_linenumber") == 3, "in").otherwise("EA")
    issued = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)
    lots = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), F.concat(F.lit("L"), F.col("l_suppkey")))
    expected = F.when(F.col("l_linenumber") > 4, F.col("l_quantity") * 2)
    req = N.required_qty(issued, lots, expected, form, uom, F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax"))
    return x.select(*LINE_KEY, dbl(req).alias("required"))


@query("proj_formula_override", f"""
with {SQL_LINES}, x as (
  select l_orderkey, l_linenumber, ln.l_partkey, l_suppkey, site, l_returnflag as op, l_quantity as q, l_tax * 10 as raw, p_retailprice as manual_hrs
  from ln left join part on ln.l_partkey = p_partkey and p_size = 1)
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       coalesce(manual_hrs, case when op = 'R' then q * cast(0.0125 as double) + cast(0.08333333 as double)
         when op = 'A' and site = 'EUROPE' then raw * cast(0.25 as double) when op = 'N' and site = 'ASIA' then (q + 5) / cast(60 as double) else raw end) as hours,
       manual_hrs is not null as manual_adjusted,
       (op = 'R' or (op = 'A' and site = 'EUROPE') or (op = 'N' and site = 'ASIA')) as calc_adjusted from x""")
def proj_formula_override(t):
    manual = t.part.filter("p_size = 1").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("manual_hrs"))
    x = site_lines(t).withColumn("raw", F.col("l_tax") * 10).join(manual, "l_partkey", "left")
    op, site, q = F.col("l_returnflag"), F.col("site"), F.col("l_quantity")
    rules = [op == "R", (op == "A") & (site == "EUROPE"), (op == "N") & (site == "ASIA")]
    calc = (F.when(rules[0], q * 0.0125 + 0.08333333).when(rules[1], F.col("raw") * 0.25)
            .when(rules[2], (q + 5) / F.lit(60.0)).otherwise(F.col("raw")))
    return x.select(*LINE_KEY, F.coalesce("manual_hrs", calc).alias("hours"), F.col("manual_hrs").isNotNull().alias("manual_adjusted"),
                    (rules[0] | rules[1] | rules[2]).alias("calc_adjusted"))


@query("proj_age_bucket", """
select o_orderkey, case when datediff('day', cast(o_orderdate as date), date '1999-06-30') < 7 then 'in_lead_time' else 'out_of_lead_time' end as lt_bucket
from orders""")
def proj_age_bucket(t):
    return t.orders.select("o_orderkey", D.lead_time_bucket(F.to_date("o_orderdate"), F.lit(AS_OF)).alias("lt_bucket"))


@query("proj_boolean_flags", """
select o_orderkey, o_orderpriority in ('1-URGENT', '2-HIGH') as in_scope, dayofweek(o_orderdate) not in (0, 6) as is_weekday,
       cast(o_orderdate as date) in (date '1996-01-01', date '1997-07-04', date '1998-12-25') as is_holiday,
       dayofweek(o_orderdate) not in (0, 6) and cast(o_orderdate as date) not in (date '1996-01-01', date '1997-07-04', date '1998-12-25') as is_business_day,
       nullif(o_orderstatus, 'P') = 'F' as is_done from orders""")
def proj_boolean_flags(t):
    from orebook.plans.shapes import HOLIDAYS

    d = F.to_date("o_orderdate")
    weekday, holiday = D.is_weekday(d), d.isin(*HOLIDAYS)
    return t.orders.select(
        "o_orderkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("in_scope"), weekday.alias("is_weekday"),
        holiday.alias("is_holiday"), (weekday & ~holiday).alias("is_business_day"),
        (F.nullif(F.col("o_orderstatus"), F.lit("P")) == "F").alias("is_done"),
    )


@query("proj_pick_by_site", f"""
with {SQL_ORDERS}
select o_orderkey, site, case site when 'AFRICA' then o_totalprice when 'ASIA' then c_acctbal when 'EUROPE' then o_totalprice + c_acctbal end as picked from so""")
def proj_pick_by_site(t):
    a, b = F.col("o_totalprice"), F.col("c_acctbal")
    return site_orders(t).select("o_orderkey", "site", N.pick_by_site(F.col("site"), {"AFRICA": a, "ASIA": b, "EUROPE": a + b}).alias("picked"))


@query("proj_unit_cost_value", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / nullif(l_quantity - 1, 0) * l_linenumber as value from lineitem""")
def proj_unit_cost_value(t):
    value = N.unit_cost_value(F.col("l_extendedprice"), F.col("l_quantity") - 1, F.col("l_linenumber"))
    return t.lineitem.select(*LINE_KEY, value.alias("value"))


@query("proj_gated_measure", f"""
with {SQL_LIFE}
select o_orderkey, case when order_date >= date '1999-06-30' then null when dayofweek(order_date) in (0, 6) then null
  when invoice_date is null then null when o_totalprice < 50000 then null else datediff('day', order_date, invoice_date) end as days_open from life""")
def proj_gated_measure(t):
    d, i = F.col("order_date"), F.col("invoice_date")
    value = N.gated(F.datediff(i, d).cast("bigint"), d >= F.lit(AS_OF), ~D.is_weekday(d), i.isNull(), F.col("o_totalprice") < 50000)
    return order_life(t).select("o_orderkey", value.alias("days_open"))
