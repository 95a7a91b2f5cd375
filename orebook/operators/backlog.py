"""Backlog over time: daily trend, targets, snapshots, report matrices."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebook.functions.dates import is_weekday, lead_time_bucket
from orebook.functions.numbers import gated
from orebook.functions.text import reason_list
from orebook.operators.allocation import NO_MATERIAL
from orebook.operators.joins import latest_effective
from orebook.operators.rollup import slots
from orebook.operators.timegrid import spine_by_site
from orebook.session import cut


def daily_changes(orders: DataFrame, site: str, ordered: str, invoiced: str) -> DataFrame:
    """Per site and day: orders placed, shipped, and leaving the backlog.

    An order leaves on the later of its two dates, so one invoiced before it was placed is
    never open. Rows without a date keep their site in the result, on a null day.
    """
    o, i = F.col(ordered), F.col(invoiced)
    closed = F.when(o.isNotNull() & i.isNotNull(), F.greatest(o, i))
    flag = lambda n, s, c: [F.lit(n).alias("new"), F.lit(s).alias("shipped"), F.lit(c).alias("closed")]
    steps = F.array(
        F.struct(o.alias("dt"), *flag(1, 0, 0)),
        F.struct(i.alias("dt"), *flag(0, 1, 0)),
        F.struct(closed.alias("dt"), *flag(0, 0, 1)),
    )
    return orders.select(F.col(site), F.inline(steps)).groupBy(site, "dt").agg(
        F.sum("new").alias("new_orders"), F.sum("shipped").alias("shipped_orders"), F.sum("closed").alias("closed_orders")
    )


def backlog_daily(orders: DataFrame, site: str, ordered: str, invoiced: str, as_of: dt.date,
                  holidays: Sequence[dt.date] = (), line: Sequence[str] = ()) -> DataFrame:
    """New, shipped and open orders per site and day up to the day before ``as_of``.

    ``line`` names the columns that make an order line: rows that repeat one (a line with two
    jobs) count once. Without it every row counts.

    Orders are reduced to daily changes first, written once for their three readers; open
    orders are a running sum over days, so days are never matched with orders. All windows
    run over one row per site and day.
    """
    if line:
        orders = orders.select(site, ordered, invoiced, *line).distinct()
    changes = cut(daily_changes(orders, site, ordered, invoiced), "daily-changes")
    lo = changes.filter("new_orders > 0").agg(F.min("dt")).scalar()
    spine = spine_by_site(changes.select(site).distinct(), lo, F.lit(as_of - dt.timedelta(days=1)))
    upto = Window.partitionBy(site).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("bigint")
    day = spine.join(changes, [site, "dt"], "left").select(
        "dt", site,
        F.coalesce("new_orders", zero).alias("new_orders"),
        F.coalesce("shipped_orders", zero).alias("shipped_orders"),
        (F.coalesce(F.sum("new_orders").over(upto), zero) - F.coalesce(F.sum("closed_orders").over(upto), zero)).alias("open_orders"),
    )
    weekday = is_weekday(F.col("dt"))
    holiday = F.col("dt").isin(*holidays) if holidays else F.lit(False)
    flagged = day.withColumns({
        "is_weekday": weekday, "is_holiday": holiday, "is_business_day": weekday & ~holiday,
    })
    return with_week_averages(flagged, site)


def with_week_averages(daily: DataFrame, site: str) -> DataFrame:
    """Trailing seven calendar days: flows over business days, the level as a plain mean."""
    w = Window.partitionBy(site).orderBy("dt").rowsBetween(-6, 0)
    business = F.nullif(F.sum(F.col("is_business_day").cast("int")).over(w), F.lit(0))
    return daily.withColumns({
        "new_orders_week_avg": F.round(F.sum("new_orders").over(w) / business, 1),
        "shipped_orders_week_avg": F.round(F.sum("shipped_orders").over(w) / business, 1),
        "backlog_week_avg": F.round(F.avg("open_orders").over(w), 1),
    })


def material_snapshot(lines: DataFrame, site: str, status: str, ordered: str, usd: str, as_of: dt.date) -> DataFrame:
    """Lines and value by site, status and lead-time bucket, stamped with the day."""
    return lines.groupBy(
        F.lit(as_of).alias("snapshot_date"), F.col(site), F.col(status),
        lead_time_bucket(F.col(ordered), F.lit(as_of)).alias("lt_bucket"),
    ).agg(F.count(F.lit(1)).alias("line_count"), F.sum(usd).alias("total_usd"))


def target_performance(daily: DataFrame, snapshots: DataFrame, targets: DataFrame, site: str, status: str,
                       as_of: dt.date) -> DataFrame:
    """Shipments against the target in force; not judged unless every gate is open."""
    n = F.col("line_count")
    stocked = F.col(status) != NO_MATERIAL
    zero = F.lit(0)
    total = lambda cond: F.sum(F.when(cond, n).otherwise(zero))
    material = snapshots.groupBy(F.col("snapshot_date").alias("dt"), site).agg(
        total(F.col(status) == NO_MATERIAL).alias("no_material"), total(stocked).alias("with_material"),
        total(stocked & (F.col("lt_bucket") == "in_lead_time")).alias("with_material_in_lt"),
        total(stocked & (F.col("lt_bucket") == "out_of_lead_time")).alias("with_material_out_lt"),
    )
    dated = latest_effective(daily, targets, site, "dt", "effective_from", ["target"])
    t, w, shipped = F.col("target"), F.col("with_material"), F.col("shipped_orders")
    gates = [F.col("dt") >= F.lit(as_of), ~F.col("is_business_day"), t.isNull(), w.isNull(), w < t]
    return dated.join(material, ["dt", site], "left").select(
        "dt", site, "target", F.col("open_orders").alias("backlog"), "no_material", "with_material",
        "with_material_in_lt", "with_material_out_lt",
        F.round(F.lit(100.0) * w / F.nullif(F.col("open_orders"), F.lit(0)), 1).alias("material_availability_pct"),
        shipped.alias("shipped"),
        gated(shipped - t, *gates).alias("variance_to_target"),
        gated(F.round(F.lit(100.0) * shipped / t, 1), *gates).alias("pct_to_target"),
    )


def active_job_review(jobs: DataFrame, keys: Sequence[str], job: str, job_site: str, job_status: str,
                      order_status: str, order_type: str, site: str, slots_n: int = 3) -> DataFrame:
    """Order lines with an active job although the order is done, or with more than one active job.

    Sums per line and the first jobs of a line are made apart; each task sends at most
    ``slots_n`` rows per line to the slots. A missing status counts in the order only as SQL
    comparisons do.
    """
    open_ = (F.col(order_status) == "Valid") & (F.col(order_type) == "Order")
    state = (
        F.when(F.col(order_status) == "Cancelled", "Cancelled")
        .when((F.col(order_status) == "Valid") & (F.col(order_type) == "Invoice"), "Invoiced")
        .when(open_, "Open")
        .otherwise(F.concat(F.col(order_status), F.lit(" / "), F.col(order_type)))
    )
    several = jobs.groupBy(*keys).agg((F.min(job) != F.max(job)).alias("__several"))
    flagged = jobs.join(several, list(keys)).filter(~open_ | F.col("__several"))
    flagged = flagged.withColumns({"__done": ~open_, "__state": state})
    summary = flagged.groupBy(*keys).agg(
        F.max(site).alias("line_site"), F.max("__state").alias("order_state"),
        reason_list(
            F.when(F.bool_or("__done"), F.lit("Terminal order with active job")),
            F.when(F.bool_or("__several"), F.lit("Multiple active jobs")),
        ).alias("reason_flagged"),
    )
    order = [F.col(c).asc_nulls_last() for c in (job, job_site, job_status)]
    side = slots(flagged.select(*keys, job, job_site, job_status), keys, order, [job, job_site, job_status], slots_n)
    return summary.join(side, list(keys))


def trend_last_days(daily: DataFrame, site: str, sites: Sequence[str], days: int) -> DataFrame:
    """Totals over the listed sites for the last ``days`` days present, oldest first."""
    sums = daily.filter(F.col(site).isin(*sites)).groupBy("dt").agg(
        *[F.sum(c).alias(c) for c in ("open_orders", "new_orders", "shipped_orders")]
    )
    return sums.orderBy(F.desc("dt")).limit(days).orderBy("dt")


def activity_matrix(daily: DataFrame, site: str, sites: Sequence[str], days: int = 7) -> DataFrame:
    """Site and metric by the last calendar days (``day_1`` oldest), week average, and a Total block."""
    last = daily.agg(F.max("dt").alias("d")).scalar()
    inside = daily.filter(F.col(site).isin(*sites) & F.col("dt").between(F.date_sub(last, days - 1), last))
    back = F.datediff(last, F.col("dt"))
    metrics = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(v).cast("double").alias("value"), F.col(a).alias("week_avg"))
        for n, v, a in (("backlog", "open_orders", "backlog_week_avg"), ("new", "new_orders", "new_orders_week_avg"),
                        ("shipped", "shipped_orders", "shipped_orders_week_avg"))
    ])
    long = inside.select(site, back.alias("back"), F.inline(metrics))
    out = long.rollup("metric", site).agg(
        *[F.coalesce(F.sum(F.when(F.col("back") == days - i, F.col("value"))), F.lit(0.0)).alias(f"day_{i}")
          for i in range(1, days + 1)],
        F.sum(F.when(F.col("back") == 0, F.col("week_avg").cast("decimal(18,1)"))).cast("double").alias("week_avg"),
        F.grouping(site).alias("__all"), F.grouping("metric").alias("__none"),
    )
    return out.filter("__none = 0").withColumn(site, F.when(F.col("__all") == 1, "Total").otherwise(F.col(site))).drop(
        "__all", "__none"
    )


def waterfall(counts: DataFrame, stage: str, value: str, stages: Sequence[str]) -> DataFrame:
    """Stages in order with the offset at which each starts; a leading Total at zero.

    The window sees one row per stage.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(stage)).cast("int")
    total = F.grouping(stage) == 1
    sums = counts.filter(F.col(stage).isin(*stages)).rollup(stage).agg(F.sum(value).alias("value"), total.alias("__all"))
    rows = sums.select(
        F.when(F.col("__all"), F.lit("Total")).otherwise(F.col(stage)).alias("stage"),
        F.when(F.col("__all"), F.lit(0)).otherwise(place).alias("position"), "value",
        F.when(~F.col("__all"), F.col("value")).alias("__step"),
    )
    w = Window.partitionBy(F.lit(0)).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("stage", "position", "value", F.coalesce(F.sum("__step").over(w), F.lit(0)).alias("start_offset"))
