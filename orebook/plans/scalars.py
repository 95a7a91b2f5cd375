"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orebook.functions import dates as D
from orebook.functions import numbers as N
from orebook.functions import text as X
from orebook.plans.joins import ITEM_RE, KEYED_ITEM, keyed_item
from orebook.plans.registry import query
from orebook.plans.shapes import dbl, dec

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def txt(c):
    return F.col(c).cast("string")


@query("fn_trim_case", "select c_custkey, lower(trim(c_name || ' ')) as lo, upper(trim('  ' || c_mktsegment)) as hi from customer")
def fn_trim_case(t):
    return t.customer.select("c_custkey", F.lower(F.trim(F.concat("c_name", F.lit(" ")))).alias("lo"),
                             F.upper(F.trim(F.concat(F.lit("  "), "c_mktsegment"))).alias("hi"))


@query("fn_split_part", """
with x as (select l_orderkey || '-' || l_linenumber || '.' || l_suppkey as k from lineitem)
select k, split_part(k, '-', 1) as order_nbr, split_part(split_part(k, '-', 2), '.', 1) as line, split_part(split_part(k, '-', 2), '.', 2) as shipment, split_part(k, '-', 3) as none from x""")
def fn_split_part(t):
    k = F.concat(txt("l_orderkey"), F.lit("-"), txt("l_linenumber"), F.lit("."), txt("l_suppkey"))
    order, line, ship = X.order_key(F.col("k"))
    return t.lineitem.select(k.alias("k")).select("k", order.alias("order_nbr"), line.alias("line"), ship.alias("shipment"),
                                                  F.split_part("k", F.lit("-"), F.lit(3)).alias("none"))


STAR = "case when l_returnflag = 'R' then l_orderkey || '*' || l_linenumber || '*' || l_suppkey when l_returnflag = 'A' then l_orderkey || '*' || l_linenumber else cast(l_partkey as varchar) end"


def star_item():
    star = F.lit("*")
    two = F.concat(txt("l_orderkey"), star, txt("l_linenumber"))
    return F.when(F.col("l_returnflag") == "R", F.concat(two, star, txt("l_suppkey"))).when(F.col("l_returnflag") == "A", two).otherwise(txt("l_partkey"))


@query("fn_composite_key_parse", f"""
with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {STAR} as item from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, position('*' in item) > 0 as is_assembly,
  case when position('*' in item) > 0 then split_part(item, '*', 1) end as assembly_order, case when position('*' in item) > 0 then split_part(item, '*', 2) end as assembly_line,
  case when position('*' in item) > 0 then split_part(item, '*', 3) end as assembly_shipment from x""")
def fn_composite_key_parse(t):
    return t.lineitem.withColumn("item", star_item()).select(*KEYS, *X.assembly_key(F.col("item")))


@query("fn_position", "select p_partkey, p_name, position(' ' in p_name) > 0 as has_blank, cast(position('e' in p_name) as integer) as first_e from part")
def fn_position(t):
    return t.part.select("p_partkey", "p_name", (F.instr("p_name", " ") > 0).alias("has_blank"), F.instr("p_name", "e").alias("first_e"))


@query("fn_coalesce_parse_link", f"""
with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {STAR} as item, case when l_linestatus = 'O' then 'S' || l_orderkey end as o,
    case when l_linestatus = 'O' then cast(l_linenumber as varchar) end as n, case when l_linestatus = 'O' then '1' end as s from lineitem),
 y as (select *, position('*' in item) > 0 and split_part(item, '*', 3) <> '' as ok from x)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when o is not null then 'default' when ok then 'assembly' end as link_source,
  coalesce(o, case when ok then split_part(item, '*', 1) end) as so_nbr, coalesce(n, case when ok then split_part(item, '*', 2) end) as so_line,
  coalesce(s, case when ok then split_part(item, '*', 3) end) as so_shipment from y""")
def fn_coalesce_parse_link(t):
    is_open = F.col("l_linestatus") == "O"
    direct = {
        "so_nbr": F.when(is_open, F.concat(F.lit("S"), txt("l_orderkey"))), "so_line": F.when(is_open, txt("l_linenumber")),
        "so_shipment": F.when(is_open, F.lit("1")),
    }
    return t.lineitem.withColumn("item", star_item()).select(*KEYS, *X.linked_key(direct, F.col("item")))


SUFFIXED = "p_brand || case p_type when 'ECONOMY' then '.CO' when 'LARGE' then '.BO' when 'SMALL' then '.XP' when 'PROMO' then '.CO.BO' else '' end"


@query("fn_suffix_strip_like", f"""
with x as (select p_partkey, {SUFFIXED} as item from part)
select p_partkey, case when item like '%.CO' then replace(item, '.CO', '') when item like '%.BO' then replace(item, '.BO', '')
  when item like '%.XP' then replace(item, '.XP', '') else item end as item_clean from x""")
def fn_suffix_strip_like(t):
    s = (F.when(F.col("p_type") == "ECONOMY", ".CO").when(F.col("p_type") == "LARGE", ".BO").when(F.col("p_type") == "SMALL", ".XP")
         .when(F.col("p_type") == "PROMO", ".CO.BO").otherwise(""))
    return t.part.select("p_partkey", F.concat("p_brand", s).alias("item")).select("p_partkey", X.strip_component_suffix(F.col("item")).alias("item_clean"))


@query("fn_suffix_strip_regex", f"select p_partkey, regexp_replace({KEYED_ITEM}, '{ITEM_RE}', '') as item_clean from part")
def fn_suffix_strip_regex(t):
    return t.part.select("p_partkey", X.clean_item(keyed_item(t)).alias("item_clean"))


@query("fn_float_string_strip", r"""
select o_orderkey, regexp_replace(o_custkey || case when o_orderstatus = 'F' then '.0' else '.05' end, '\.0$', '') as job from orders""")
def fn_float_string_strip(t):
    raw = F.concat(txt("o_custkey"), F.when(F.col("o_orderstatus") == "F", ".0").otherwise(".05"))
    return t.orders.select("o_orderkey", X.strip_point_zero(raw).alias("job"))


@query("fn_date_two_digit_year", """
select o_orderkey, case when o_orderstatus <> 'P' then make_date(case when year(o_orderdate) < 2000 then year(o_orderdate) + 100 else year(o_orderdate) end, month(o_orderdate), day(o_orderdate)) end as parsed from orders""")
def fn_date_two_digit_year(t):
    raw = F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.upper(F.date_format("o_orderdate", "dd-MMM-yy")))
    return t.orders.select("o_orderkey", X.two_digit_year_date(raw).alias("parsed"))


@query("fn_label_format", """
select o_orderkey, right(cast(year(o_orderdate) as varchar), 2) || '-' || lpad(cast(month(o_orderdate) as varchar), 2, '0') as fiscal_yy_mm,
  cast(year(o_orderdate) as varchar) || '-' || lpad(cast(month(o_orderdate) as varchar), 2, '0') as fiscal_yyyy_mm,
  left(monthname(o_orderdate), 3) || '-' || right(cast(year(o_orderdate) as varchar), 2) as fiscal_mon_yy,
  left(monthname(o_orderdate), 3) || '-' || cast(year(o_orderdate) as varchar) as fiscal_mon_yyyy from orders""")
def fn_label_format(t):
    labels = D.fiscal_labels(F.year("o_orderdate"), F.month("o_orderdate"), F.date_format("o_orderdate", "MMMM"))
    return t.orders.select("o_orderkey", *labels)


@query("fn_period_key", "select o_orderkey, cast(year(o_orderdate) * 100 + month(o_orderdate) as integer) as month_key, cast(isoyear(o_orderdate) * 100 + week(o_orderdate) as integer) as week_key from orders")
def fn_period_key(t):
    iso = F.expr("extract(yearofweek from o_orderdate)")
    return t.orders.select("o_orderkey", D.period_key(F.year("o_orderdate"), F.month("o_orderdate")).alias("month_key"),
                           D.period_key(iso, F.weekofyear("o_orderdate")).alias("week_key"))


@query("fn_concat_pipe", "select o_orderkey, nullif(o_orderstatus, 'P') || ' / ' || o_orderpriority as state from orders")
def fn_concat_pipe(t):
    return t.orders.select("o_orderkey", F.concat(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit(" / "), F.col("o_orderpriority")).alias("state"))


@query("fn_reason_list", """
select o_orderkey, concat_ws('; ', case when o_orderstatus = 'F' then 'Closed order' end, case when o_totalprice > 300000 then 'Large order' end) as reasons from orders""")
def fn_reason_list(t):
    return t.orders.select("o_orderkey", X.reason_list(F.when(F.col("o_orderstatus") == "F", "Closed order"),
                                                       F.when(F.col("o_totalprice") > 300000, "Large order")).alias("reasons"))


@query("fn_regex_extract", r"""
with x as (select c_custkey, case when c_nationkey = 3 then c_name else c_mktsegment || ' (' || c_custkey || ')' end as who from customer)
select c_custkey, nullif(regexp_extract(who, '\((\d+)\)', 1), '') as id, nullif(regexp_extract(who, '^(.*) \(\d+\)', 1), '') as name, nullif(regexp_extract(who, '(^\d+)', 1), '') as digits from x""")
def fn_regex_extract(t):
    who = F.when(F.col("c_nationkey") == 3, F.col("c_name")).otherwise(F.concat("c_mktsegment", F.lit(" ("), txt("c_custkey"), F.lit(")")))
    x = t.customer.select("c_custkey", who.alias("who"))
    w = F.col("who")
    return x.select("c_custkey", X.extract_or_null(w, r"\((\d+)\)").alias("id"), X.extract_or_null(w, r"^(.*) \(\d+\)").alias("name"),
                    X.extract_or_null(w, r"(^\d+)").alias("digits"))


@query("fn_split_expand", """
with x as (select page_id, string_split(url, '/') as p from pages)
select page_id, p[1] as scheme, p[3] as host, p[4] as section, p[6] as deep from x""")
def fn_split_expand(t):
    p = F.split("url", "/")
    return t.pages.select("page_id", *[p.getItem(i).alias(n) if i < 4 else F.get(p, F.lit(i)).alias(n)
                                       for i, n in ((0, "scheme"), (2, "host"), (3, "section"), (5, "deep"))])


@query("fn_dict_map", """
select n_nationkey, case n_nationkey when 1 then 'S5' when 3 then 'S6' when 24 then 'S24' end as site from nation""")
def fn_dict_map(t):
    return t.nation.select("n_nationkey", X.lookup(F.col("n_nationkey"), {1: "S5", 3: "S6", 24: "S24"}).alias("site"))


@query("fn_numeric_coerce", """
with x as (select doc_id, case when lang = 'en' then cast(n_chars as varchar) when lang = 'fr' then '' else source end as v from documents)
select doc_id, coalesce(try_cast(v as double), 0) as hours from x""")
def fn_numeric_coerce(t):
    v = F.when(F.col("lang") == "en", txt("n_chars")).when(F.col("lang") == "fr", "").otherwise(F.col("source"))
    return t.documents.select("doc_id", N.coerce(v).alias("hours"))


@query("fn_id_normalise", """
select c_custkey, case when c_nationkey = 5 then null else cast(c_custkey as varchar) end as id, c_custkey || ' - ' || c_mktsegment as plan_id from customer""")
def fn_id_normalise(t):
    raw = F.when(F.col("c_nationkey") == 5, "n/a").otherwise(F.concat(txt("c_custkey"), F.lit(".0")))
    plan = F.concat(X.id_text(F.concat(txt("c_custkey"), F.lit(".0"))), F.lit(" - "), F.col("c_mktsegment"))
    return t.customer.select("c_custkey", X.id_text(raw).alias("id"), plan.alias("plan_id"))


@query("fn_round", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(cast(l_extendedprice as decimal(18,2)), 1) as double) as r1,
  cast(round(cast(-l_extendedprice as decimal(18,2)), 0) as double) as r0 from lineitem""")
def fn_round(t):
    return t.lineitem.select(*KEYS, dbl(F.round(dec("l_extendedprice"), 1)).alias("r1"), dbl(F.round((-F.col("l_extendedprice")).cast("decimal(18,2)"), 0)).alias("r0"))


@query("fn_abs_nullif_coalesce", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_discount - l_tax) as gap, coalesce(nullif(l_tax, 0), nullif(l_discount, 0), 1) as first_rate from lineitem""")
def fn_abs_nullif_coalesce(t):
    zero = F.lit(0)
    first = F.coalesce(F.nullif(F.col("l_tax"), zero), F.nullif(F.col("l_discount"), zero), F.lit(1))
    return t.lineitem.select(*KEYS, F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"), first.alias("first_rate"))


@query("fn_greatest_least", """
select event_id, date_diff('microsecond', greatest(ts - interval 7 hour, date_trunc('day', ts)), least(ts, date_trunc('day', ts) + interval 1 day)) as us from events""")
def fn_greatest_least(t):
    day = F.to_date("ts")
    sec = D.overlap_seconds(F.col("ts") - F.expr("interval 7 hours"), F.col("ts"), day)
    return t.events.select("event_id", (sec * 1000000).cast("bigint").alias("us"))


@query("fn_epoch_interval", """
with b as (select event_id, ts, ts - to_microseconds(cast(round(cast(value * 60 as decimal(18,6)) * 1000000) as bigint)) as s from events)
select event_id, s as start_ts, date_diff('microsecond', s, ts) as us from b""")
def fn_epoch_interval(t):
    start = D.seconds_before(F.col("ts"), F.col("value") * 60)
    x = t.events.select("event_id", "ts", start.alias("start_ts"))
    return x.select("event_id", "start_ts", (D.seconds_between(F.col("start_ts"), F.col("ts")) * 1000000).cast("bigint").alias("us"))


@query("fn_date_trunc_parts", """
select event_id, cast(date_trunc('day', ts) as date) as day, cast(date_trunc('hour', ts) as timestamp) as hour, cast(year(ts) as integer) as y, cast(month(ts) as integer) as m, cast(dayofweek(ts) as integer) as dow from events""")
def fn_date_trunc_parts(t):
    return t.events.select("event_id", F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
                           F.year("ts").alias("y"), F.month("ts").alias("m"), (F.dayofweek("ts") - 1).alias("dow"))


@query("fn_date_shift", """
select o_orderkey, cast(cast(o_orderdate as date) - interval 13 day as date) as two_weeks, cast(cast(o_orderdate as date) - interval 12 month as date) as year_ago from orders""")
def fn_date_shift(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.date_sub(d, 13).alias("two_weeks"), F.add_months(d, -12).alias("year_ago"))


@query("fn_to_char_date", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d from orders")
def fn_to_char_date(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))


@query("fn_json_build", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(to_json({'site': l_returnflag, 'vendor': l_suppkey, 'date': strftime(l_shipdate, '%Y-%m-%d')}) as varchar) as detail from lineitem""")
def fn_json_build(t):
    detail = F.to_json(F.struct(F.col("l_returnflag").alias("site"), F.col("l_suppkey").alias("vendor"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date")))
    return t.lineitem.select(*KEYS, detail.alias("detail"))


@query("fn_json_stringify", """
select event_id, event_type, '{"k":' || cast(json_extract(props, '$.k') as varchar) || '}' as props, '["' || event_type || '",' || '"' || user_id || '"]' as tags from events""")
def fn_json_stringify(t):
    x = t.events.select("event_id", "event_type", F.from_json("props", "k bigint").alias("props"), F.array("event_type", txt("user_id")).alias("tags"))
    return X.jsonify(x)
