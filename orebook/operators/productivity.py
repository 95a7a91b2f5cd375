"""Productivity: hours by period and week, payout bands, employee payouts, period extracts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebook.functions.numbers import ratio
from orebook.operators.joins import top_band
from orebook.operators.rollup import stack
from orebook.session import cut


def _dated(hours: DataFrame, completed: DataFrame, job: str) -> DataFrame:
    """Included hours with the completion date of their job; hours without the flag go first."""
    return hours.filter("include").join(completed, job)


def earned_by_period(hours: DataFrame, completed: DataFrame, activity: DataFrame, calendar: DataFrame, job: str,
                     site: str) -> DataFrame:
    """Earned hours by site and fiscal month: included job hours, and activity hours always.

    Both feeds are reduced to (site, date) before they meet the calendar.
    """
    daily = stack([
        _dated(hours, completed, job).select(site, "date", "earned_hours"),
        activity.select(site, "date", "earned_hours"),
    ]).groupBy(site, "date").agg(F.sum("earned_hours").alias("earned_hours"))
    cal = calendar.select(F.col("calendar_date").alias("date"), F.col("fiscal_year").alias("year"),
                          F.col("fiscal_month").alias("month"))
    return daily.join(cal, "date").groupBy(site, "year", "month").agg(F.sum("earned_hours").alias("earned_hours"))


def earned_by_week(hours: DataFrame, completed: DataFrame, activity: DataFrame, calendar: DataFrame, job: str,
                   op: str, site: str, as_of: dt.date) -> DataFrame:
    """The same by site, operation and fiscal week, for weeks that ended before ``as_of``."""
    daily = stack([
        _dated(hours, completed, job).select(site, op, "date", "earned_hours"),
        activity.select(site, op, "date", "earned_hours"),
    ]).groupBy(site, op, "date").agg(F.sum("earned_hours").alias("earned_hours"))
    weeks = calendar.filter(F.col("fiscal_week_end_date") < F.lit(as_of)).select(
        F.col("calendar_date").alias("date"), "fiscal_year", "fiscal_week", "fiscal_week_start_date", "fiscal_week_end_date"
    )
    return daily.join(weeks, "date").groupBy(
        site, op, "fiscal_year", "fiscal_week", "fiscal_week_start_date", "fiscal_week_end_date"
    ).agg(F.sum("earned_hours").alias("earned_hours"))


def earned_detail(hours: DataFrame, attributes: DataFrame, activity: DataFrame, job: str) -> DataFrame:
    """Job and operation rows with product attributes, activity rows with the missing columns null."""
    return stack([hours.join(attributes, job, "left"), activity])


def worked_summary(hours: DataFrame) -> DataFrame:
    keys = ("country", "site", "year", "month")
    return hours.groupBy(*keys).agg(
        *[F.sum(f"{k}_hrs").alias(f"worked_{k}_hrs") for k in ("regular", "overtime", "total")]
    )


def banded_payout(worked: DataFrame, earned: DataFrame, timing: DataFrame, bands: DataFrame, overrides: DataFrame,
                  sites: Sequence[str] | None = None) -> DataFrame:
    """Productivity per site and month, the highest band it reaches, and the payout; for ``sites`` only, if given.

    ``timing`` maps (year, month) to the target year; ``bands`` has (site, year, band_pct,
    goal_pct, payout_usd, uom); an override replaces the band's payout.
    """
    if sites is not None:
        worked = worked.filter(F.col("site").isin(*sites))
    out = worked.join(earned, ["site", "year", "month"], "left").withColumn(
        "earned_hours", F.coalesce("earned_hours", F.lit(0))
    )
    out = out.withColumn("productivity_pct", ratio(F.col("earned_hours"), F.col("worked_total_hrs")))
    out = out.join(timing, ["year", "month"], "left")
    ladder = bands.select("site", F.col("year").alias("target_year"), "band_pct", "goal_pct", "payout_usd", "uom")
    out = top_band(out, ["site", "year", "month"], ladder, ["site", "target_year"], "productivity_pct", "goal_pct",
                   "band_pct", ["payout_usd", "uom"])
    full = ladder.filter("band_pct = 1").select("site", "target_year", F.col("goal_pct").alias("target_pct"))
    out = out.join(full, ["site", "target_year"], "left")
    fixed = overrides.select("site", "year", "month", F.col("payout_usd").alias("__fixed"))
    return out.join(fixed, ["site", "year", "month"], "left").withColumn(
        "payout_usd", F.coalesce("__fixed", "payout_usd")
    ).drop("__fixed")


def employee_payout(hours: DataFrame, results: DataFrame, temp: str = "TEMP", sites: Sequence[str] | None = None) -> DataFrame:
    """Hours times the site's rate; temporary staff get none. For ``sites`` only, if given."""
    if sites is not None:
        hours = hours.filter(F.col("site").isin(*sites))
    rate = F.coalesce("payout_usd", F.lit(0))
    return hours.join(results.select("site", "year", "month", "payout_usd"), ["site", "year", "month"], "left").withColumn(
        "month_bonus", F.when(F.col("employee_name") == temp, F.lit(0)).otherwise(F.col("total_hrs") * rate)
    )


def period_results(results: DataFrame, year: int, month: int) -> DataFrame:
    """Results of all months that share the target year of the given month; read twice, worked out once."""
    results = cut(results, "period-results")
    target = results.filter((F.col("year") == year) & (F.col("month") == month)).agg(F.max("target_year")).scalar()
    return results.filter(F.col("target_year") == target)


def period_targets(bands: DataFrame, target_year: int) -> DataFrame:
    """Bands of a target year without the zero band."""
    return bands.filter((F.col("year") == target_year) & (F.col("band_pct") != 0))


def period_detail(detail: DataFrame, year: int, month: int, columns: Sequence[str]) -> DataFrame:
    return detail.filter((F.col("year") == year) & (F.col("month") == month)).select(*columns)
