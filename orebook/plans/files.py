"""Sources and sinks: files are written from the given tables to the shared folder, then read or checked."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from orebook.functions import clean as C
from orebook.plans.registry import query
from orebook.plans.shapes import SQL_ORDERS, dbl, dec, site_orders
from orebook.session import shared_path
from orebook.sinks import writers as W
from orebook.sinks.published import PublishedTable
from orebook.sources import csv_files as S
from orebook.sources import feeds as FD
from orebook.sources import numbered as N
from orebook.sources import tables as T


def _text(c):
    return F.col(c).cast("string")


def _orders_text(t):
    return t.orders.select(
        _text("o_orderkey").alias("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), "o_orderstatus", "o_orderpriority"
    )


def _titled_files(rows, titles, path):
    """Lines (``at``, ``value``) in as many files as there are shuffle partitions, each with the ``titles`` on top."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = F.posexplode(F.array(*map(F.lit, titles)))
    heads = spark.range(parts).select(F.col("id").cast("int").alias("part"), top).select("part", F.lit(0).alias("below"), F.col("pos").cast("long").alias("at"), F.col("col").alias("value"))
    dealt = rows.select(F.pmod(F.hash("at"), F.lit(parts)).alias("part"), F.lit(1).alias("below"), "at", "value")
    lines = heads.union(dealt).repartition(parts, "part").sortWithinPartitions("part", "below", "at")
    lines.select("part", "value").write.partitionBy("part").text(path)


@query("src_csv_na", """
select cast(o_orderkey as varchar) as o_orderkey, case o_orderstatus when 'P' then null when 'O' then null else o_orderpriority end as note,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then null else cast(o_orderdate as date) end as order_date from orders""")
def src_csv_na(t):
    path = shared_path(t.spark, "csv-na")
    status = F.col("o_orderstatus")
    note = F.when(status == "P", "Undefined").when(status == "O", "#DIV/0!").otherwise(F.col("o_orderpriority"))
    day = F.when(F.col("o_orderpriority") == "1-URGENT", "N/A").when(F.col("o_orderpriority") == "2-HIGH", "").otherwise(F.col("order_date"))
    raw = _orders_text(t).select(F.col("o_orderkey").alias("o_orderkey "), note.alias(" note"), day.alias("order_date"))
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("encoding", "ISO-8859-1").csv(path)
    out = S.read_text_csv(t.spark, path, columns=["o_orderkey ", " note", "order_date"], encoding="ISO-8859-1")
    return out.withColumn("order_date", F.col("order_date").cast("date"))


@query("src_history_concat", """
select cast(o_orderkey as varchar) as o_orderkey, o_orderpriority, cast(year(o_orderdate) as varchar) as year, case when year(o_orderdate) >= 2000 then o_orderstatus end as o_orderstatus from orders""")
def src_history_concat(t):
    """Two closed periods and the current one; only the current file has the status."""
    base, rows = shared_path(t.spark, "history"), _orders_text(t).withColumn("year", F.split_part("order_date", F.lit("-"), F.lit(1)))
    old, cols = ["o_orderkey", "o_orderpriority", "year"], ["o_orderkey", "o_orderpriority", "year", "o_orderstatus"]
    rows.filter("year < '1998'").select(*old).write.option("header", True).csv(f"{base}/h1")
    rows.filter("year between '1998' and '1999'").select(*old).write.option("header", True).csv(f"{base}/h2")
    rows.filter("year >= '2000'").select(*cols).write.option("header", True).csv(f"{base}/now")
    history = S.read_text_csv(t.spark, [f"{base}/h1", f"{base}/h2"], columns=old)
    return S.with_history(S.read_text_csv(t.spark, f"{base}/now", columns=cols), [history])


@query("src_header_normalise", """
select o_orderkey as order_key, o_totalprice as total_us, o_orderstatus as pct_done, o_orderpriority as col_3 from orders""")
def src_header_normalise(t):
    raw = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority").toDF(" Order  Key ", "Total (US$)", "% Done", " ")
    plain = raw.toDF(*[C.header_simple(c) if "%" in c else c for c in raw.columns])
    return S.rename_strict(plain)


@query("src_rename_map", "select o_orderkey as order_nbr, o_orderstatus as order_status, o_totalprice as sales_usd from orders")
def src_rename_map(t):
    raw = t.orders.withColumnsRenamed({"o_orderkey": "Order Number", "o_orderstatus": "Line Status", "o_totalprice": "Sales (US$)"})
    return S.rename_by_map(raw, {"Order Number": "order_nbr", "Line Status": "order_status", "Sales (US$)": "sales_usd"})


def _site_files(t):
    path = shared_path(t.spark, "sites")
    rows = site_orders(t).select(F.concat(F.lit("Inventory_"), "site", F.lit(".txt")).alias("file"), _text("o_orderkey").alias("lot"), "o_orderpriority", "o_orderstatus")
    rows.write.partitionBy("file").csv(path)
    return f"{path}/file=*"


@query("src_headerless_with_site", f"""
with {SQL_ORDERS} select cast(o_orderkey as varchar) as lot, o_orderpriority as grade, o_orderstatus as status, site from so""")
def src_headerless_with_site(t):
    out = S.read_text_csv(t.spark, _site_files(t), columns=["lot", "grade", "status"], header=False, with_file=True)
    return out.withColumn("site", S.site_from_file(F.col("file_path"))).drop("file_path")


@query("src_glob_stack", f"with {SQL_ORDERS} select cast(o_orderkey as varchar) as lot, o_orderpriority as grade from so")
def src_glob_stack(t):
    return S.read_text_csv(t.spark, _site_files(t), columns=["lot", "grade", "status"], header=False).drop("status")


@query("src_period_from_filename", """
select cast(month(o_orderdate) as integer) as month, cast(year(o_orderdate) as integer) as year, cast(o_orderkey as varchar) as o_orderkey, o_orderpriority from orders""")
def src_period_from_filename(t):
    path = shared_path(t.spark, "periods")
    rows = t.orders.select(F.concat(F.lit("hours_"), F.date_format("o_orderdate", "MM-yyyy"), F.lit(".csv")).alias("file"), _text("o_orderkey").alias("o_orderkey"), "o_orderpriority")
    # Rows of a month come together so that files stay few; a month too large for one task is split.
    rows.hint("rebalance", "file").write.partitionBy("file").option("header", True).csv(path)
    out = S.read_text_csv(t.spark, f"{path}/file=*", columns=["o_orderkey", "o_orderpriority"], with_file=True)
    return out.select(*S.period_from_file(F.col("file_path")), "o_orderkey", "o_orderpriority")


@query("src_snapshot_conform", """
select cast(o_orderkey as varchar) as order_line, case when o_orderstatus <> 'O' then o_orderpriority end as reason, '06.18.98' as source_tab, date '1998-06-18' as snapshot_date from orders where o_orderstatus = 'F'
union all select cast(o_orderkey as varchar), o_orderpriority, '07.01.98', date '1998-07-01' from orders where o_orderstatus = 'P'
union all select cast(o_orderkey as varchar), null, 'Old stuff', null from orders where o_orderstatus = 'O'""")
def src_snapshot_conform(t):
    """A file per snapshot, read in one scan: a blank header and an extra column, a missing column, a name that is no date."""
    path = shared_path(t.spark, "snapshots")
    key, reason = _text("o_orderkey"), F.col("o_orderpriority")
    forms = {
        "F": ("06.18.98", "Order Line,Reason", F.concat_ws(",", key, reason)),
        "P": ("07.01.98", "order line , ,stray", F.concat_ws(",", key, reason, _text("o_totalprice"))),
        "O": ("Old stuff", "Order-Line", key),
    }
    for status, (tab, head, line) in forms.items():
        rows = t.orders.filter(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("at"), line.alias("value"))
        _titled_files(rows, ["Report of the day", head], f"{path}/tab={tab}")
    tab = lambda file: F.url_decode(F.regexp_extract(file, "tab=([^/]*)/", 1))
    return N.read_snapshots(t.spark, f"{path}/tab=*/part=*", ["Order Line", "Reason"], tab, skip=1)


@query("src_db_table", "select p_partkey, p_brand, p_retailprice from part")
def src_db_table(t):
    return T.pruned(t.part, ["p_partkey", "p_brand", "p_retailprice"])


@query("src_db_pushed_join", """
select l_orderkey, l_linenumber, l_partkey, l_quantity, p_name, p_type from lineitem left join part on l_partkey = p_partkey""")
def src_db_pushed_join(t):
    facts = T.pruned(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    return T.left_dimension(facts, t.part, ("l_partkey", "p_partkey"), ["p_name", "p_type"])


@query("src_rates_json", """
with r as (select cast(o_orderdate as date) as d, o_orderpriority as ccy, case o_orderpriority when '3-MEDIUM' then 0 when '5-LOW' then null else cast(sum(cast(o_totalprice as decimal(18,2))) as double) / 1000 end as x from orders group by 1, 2)
select d as rate_date, ccy as from_currency, 'USD' as to_currency, round(1 / x, 8) as rate from r where x is not null and x <> 0""")
def src_rates_json(t):
    """One payload per day: the quotes of a day are as many as there are currencies."""
    ccy = F.col("o_orderpriority")
    x = dbl(F.sum(dec("o_totalprice"))) / 1000
    quotes = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), ccy.alias("ccy")).agg(x.alias("x"))
    quote = F.when(F.col("ccy") == "3-MEDIUM", 0.0).when(F.col("ccy") != "5-LOW", F.col("x"))
    days = quotes.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("ccy", quote.alias("x")))).alias("q"))
    payload = F.to_json(F.struct(F.lit("USD").alias("base"), F.create_map("d", "q").alias("rates")))
    return FD.rates_long(days.select(payload.alias("payload")))


@query("src_device_records_json", """
select cast(user_id as varchar) as device_id, 'press ' || user_id as device_name, cast(event_id as varchar) as event_id, event_type as state, value as seconds from events where user_id <> 7""")
def src_device_records_json(t):
    """Payloads of at most a thousand records per device; one device sends text that does not parse."""
    names = F.array(*[F.struct(F.lit(n).alias("name")) for n in ("event_id", "state", "seconds")])
    batch = t.events.groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("batch")).agg(
        F.collect_list(F.array(_text("event_id"), F.col("event_type"), _text("value"))).alias("records")
    )
    good = F.to_json(F.struct(_text("user_id").alias("device"), names.alias("columns"), "records"))
    payloads = batch.select("user_id", F.when(F.col("user_id") == 7, F.lit('{"columns": [')).otherwise(good).alias("payload"))
    out = FD.device_records(payloads, _text("user_id"), F.concat(F.lit("press "), _text("user_id")))
    r = F.col("record")
    return out.select("device_id", "device_name", r["event_id"].alias("event_id"), r["state"].alias("state"), r["seconds"].cast("double").alias("seconds"))


@query("src_strip_invisible", r"""
select doc_id, nullif(regexp_replace(text, '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'), 'nan') as text, case when lang = 'fr' then null else lang end as lang from documents""")
def src_strip_invisible(t):
    lang = F.when(F.col("lang") == "fr", F.lit("​nan﻿")).otherwise(F.concat(F.lit("‪"), "lang", F.lit("⁠")))
    return C.strip_invisible_all(t.documents.select("doc_id", "text", lang.alias("lang")))


@query("src_seed_typed", """
select cast(date '2024-01-01' + n_nationkey as date) as date, n_nationkey as week_of_year, n_name as month_name from nation""")
def src_seed_typed(t):
    path = shared_path(t.spark, "seed")
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("n_nationkey"))
    rows = t.nation.select(F.date_format(day, "M/d/yyyy").alias("date"), F.col("n_nationkey").alias("week_of_year"), F.col("n_name").alias("month_name"))
    W.csv_with_bom(rows, path)
    return S.read_seed(t.spark, path, "date date, week_of_year int, month_name string")


@query("sink_truncate_evolve", """
select o_orderkey, o_orderpriority, cast(o_totalprice as varchar) as extra from orders where o_orderstatus = 'P'
union all select o_orderkey, null, null from orders where o_orderstatus = 'O'""")
def sink_truncate_evolve(t):
    """Replace, then truncate with a new column (kept as text), then append with a column missing."""
    table = PublishedTable(t.spark, shared_path(t.spark, "load"))
    part = lambda s, *cols: t.orders.filter(F.col("o_orderstatus") == s).select(*cols)
    table.replace(part("F", "o_orderkey", "o_orderpriority"))
    table.truncate(part("P", "o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("extra")))
    table.append(part("O", "o_orderkey"))
    return table.read()


@query("sink_view_or_table", """
select o_custkey, count(*) as n, cast(max(o_orderdate) as date) as last_order from orders where o_orderstatus <> 'P' group by 1""")
def sink_view_or_table(t):
    view = W.materialise(t.orders.filter("o_orderstatus != 'P'"), "closed_orders", "view")
    per = view.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.to_date(F.max("o_orderdate")).alias("last_order"))
    return W.materialise(per, "customer_orders", "table")


@query("sink_incremental_snapshot", """
select date '1998-01-01' as snapshot_date, o_orderpriority, count(*) as n from orders where o_orderdate < timestamp '1998-01-01' group by 2
union all select date '1999-01-01', o_orderpriority, count(*) from orders where o_orderdate < timestamp '1999-01-01' group by 2""")
def sink_incremental_snapshot(t):
    path = shared_path(t.spark, "snapshot-log")

    def snap(day, extra=0):
        rows = t.orders.filter(F.col("o_orderdate") < F.lit(str(day)).cast("timestamp_ntz")).groupBy("o_orderpriority")
        return rows.agg((F.count(F.lit(1)) + extra).alias("n")).withColumn("snapshot_date", F.lit(day))

    W.log_snapshot(snap(dt.date(1998, 1, 1)), path)
    W.log_snapshot(snap(dt.date(1999, 1, 1)), path)
    W.log_snapshot(snap(dt.date(1998, 1, 1), extra=1), path)  # a day already logged stays
    return t.spark.read.parquet(path).select("snapshot_date", "o_orderpriority", "n")


@query("sink_merge_by_key", """
with per as (select cast(date_trunc('year', o_orderdate) as date) as day, o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2, 3)
select day, o_orderstatus, o_orderpriority, cast(case when o_orderstatus = 'P' and day >= date '1996-01-01' then n + 1 else n end as bigint) as n from per where o_orderstatus <> 'O' or day >= date '1997-01-01'""")
def sink_merge_by_key(t):
    """Logged rows replaced by key: a load without some days, an overlapping one with other counts, and that one again."""
    table = PublishedTable(t.spark, shared_path(t.spark, "merged"), partition="day")
    keys = ["day", "o_orderstatus", "o_orderpriority"]
    per = t.orders.groupBy(F.to_date(F.date_trunc("year", "o_orderdate")).alias("day"), "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    table.merge(per.filter("o_orderstatus <> 'O'"), keys)
    later = per.filter("(o_orderstatus = 'O' and day >= date '1997-01-01') or (o_orderstatus = 'P' and day >= date '1996-01-01')")
    later = later.withColumn("n", F.col("n") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0))
    table.merge(later, keys)
    table.merge(later, keys)
    return table.read().select(*keys, "n")


@query("src_csv_title_rows", """
select cast(o_orderkey as varchar) as o_orderkey, nullif(o_orderpriority, '5-LOW') as note, strftime(o_orderdate, '%Y-%m-%d') as order_date from orders""")
def src_csv_title_rows(t):
    """Seven title rows, one of them like data and one blank, above a header whose columns are in another order."""
    path = shared_path(t.spark, "titles")
    top = ["Report", "", '"a, b",c', "1,2,3", "x", "", "end", "order_date, note,o_orderkey"]
    note = F.when(F.col("o_orderpriority") == "5-LOW", "N/A").otherwise(F.concat(F.lit('"'), "o_orderpriority", F.lit('"')))
    rows = _orders_text(t).select(F.col("o_orderkey").cast("long").alias("at"), F.concat_ws(",", "order_date", note, "o_orderkey").alias("value"))
    _titled_files(rows, top, path)
    return N.read_csv_skipping(t.spark, f"{path}/part=*", 7, ["o_orderkey", "note", "order_date"])


@query("sink_csv_bom_archive", """
select cast(o_orderkey as varchar) as o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as order_date, o_orderpriority, copy from orders, (values ('now'), ('1999-06-30')) c(copy) where o_orderstatus = 'F'""")
def sink_csv_bom_archive(t):
    path = shared_path(t.spark, "extract")
    targets = {"now": f"{path}/current", "1999-06-30": f"{path}/archive/1999-06-30"}
    W.csv_with_bom(_orders_text(t).select("o_orderkey", "order_date", "o_orderpriority", "o_orderstatus"), targets["now"],
                   where=F.col("o_orderstatus") == "F", archive=targets["1999-06-30"])
    cols = "o_orderkey string, order_date string, o_orderpriority string, o_orderstatus string"
    read = lambda name: S.read_seed(t.spark, targets[name], cols).withColumn("copy", F.lit(name)).drop("o_orderstatus")
    return read("now").unionByName(read("1999-06-30"))


@query("sink_sorted_extract", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate from lineitem order by l_shipdate desc nulls last, l_orderkey, l_linenumber, l_partkey, l_suppkey""")
def sink_sorted_extract(t):
    keys = [("l_shipdate", False), ("l_orderkey", True), ("l_linenumber", True), ("l_partkey", True), ("l_suppkey", True)]
    return W.sorted_extract(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"), keys)


@query("sink_per_site_files", f"""
with {SQL_ORDERS} select o_orderkey, o_totalprice, site, true as in_site_file from so union all select o_orderkey, o_totalprice, site, false from so""")
def sink_per_site_files(t):
    path = shared_path(t.spark, "per-site")
    rows = site_orders(t).select("o_orderkey", "o_totalprice", "site")
    W.per_site_files(rows, "site", f"{path}/sites", f"{path}/master")
    cols = ["o_orderkey", "o_totalprice", "site"]
    return t.spark.read.parquet(f"{path}/sites").select(*cols, F.lit(True).alias("in_site_file")).unionByName(
        t.spark.read.parquet(f"{path}/master").select(*cols, F.lit(False).alias("in_site_file"))
    )
