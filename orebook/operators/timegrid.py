"""Time: date spines, the 4-4-5 calendar, intervals split by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebook.functions import dates as D
from orebook.operators.joins import keep_top


def date_spine(lo: Column, hi: Column) -> Column:
    """All days from ``lo`` to ``hi`` as rows; none when ``lo`` is after ``hi``."""
    days = F.when(lo <= hi, F.sequence(lo, hi, F.expr("interval 1 day")))
    return F.explode(days)


def spine_by_site(sites: DataFrame, lo: Column, hi: Column, name: str = "dt") -> DataFrame:
    """Every site on every day; the days are built in place, so nothing is cross joined."""
    return sites.withColumn(name, date_spine(lo, hi))


def calendar_445(base: DataFrame) -> DataFrame:
    """Fiscal keys, labels and period bounds for a table of
    (calendar_date, fiscal_year, fiscal_month, fiscal_week, month_name)."""
    y, m, w = F.col("fiscal_year"), F.col("fiscal_month"), F.col("fiscal_week")
    by_month, by_week = Window.partitionBy("fiscal_year", "fiscal_month"), Window.partitionBy("fiscal_year", "fiscal_week")
    d = F.col("calendar_date")
    return base.select(
        "*",
        D.period_key(y, m).alias("fiscal_year_month_key"),
        D.period_key(y, w).alias("fiscal_year_week_key"),
        *D.fiscal_labels(y, m, F.col("month_name")),
        F.min(d).over(by_month).alias("fiscal_month_start_date"),
        F.max(d).over(by_month).alias("fiscal_month_end_date"),
        F.min(d).over(by_week).alias("fiscal_week_start_date"),
        F.max(d).over(by_week).alias("fiscal_week_end_date"),
    )


def fiscal_445(days: DataFrame, day: str = "calendar_date") -> DataFrame:
    """The 4-4-5 fields of each day by rule: ISO weeks, months of 4, 4 and 5 weeks per quarter.
    A 53rd week counts as week 1 of month 1 of the next year, so that month has 35 days. A company's own calendar
    may follow no rule; where there is one, it is given to :func:`calendar_445` in place of this."""
    d = F.col(day)
    extra = F.weekofyear(d) == 53
    in_year = F.when(extra, 1).otherwise(F.weekofyear(d))
    quarter = F.floor((in_year - 1) / 13).cast("int")
    in_quarter = in_year - quarter * 13
    nth = F.when(in_quarter <= 4, 1).when(in_quarter <= 8, 2).otherwise(3)
    month = quarter * 3 + nth
    return days.select(
        d.alias("calendar_date"), (F.extract(F.lit("YEAROFWEEK"), d) + extra.cast("int")).alias("fiscal_year"), month.alias("fiscal_month"),
        in_year.alias("fiscal_week"), (in_quarter - (nth - 1) * 4).alias("week_of_month"),
        F.element_at(F.array(*[F.lit(x) for x in D.MONTHS]), month).alias("month_name"),
    )


def split_interval_by_day(df: DataFrame, end: str, seconds: str, min_seconds: float = 0,
                          max_seconds: float = 10000) -> DataFrame:
    """One row per calendar day an interval touches, with its share of the seconds.

    The length is bounded by ``max_seconds``, so a row explodes into few days.
    """
    s = F.col(seconds)
    base = df.filter((s > min_seconds) & (s < max_seconds)).withColumn(
        "start_datetime", D.seconds_before(F.col(end), s)
    )
    days = F.sequence(F.to_date("start_datetime"), F.to_date(end), F.expr("interval 1 day"))
    out = base.withColumn("event_date", F.explode(days))
    out = out.withColumn(
        "allocated_duration_sec", D.overlap_seconds(F.col("start_datetime"), F.col(end), F.col("event_date"))
    )
    return out.filter("allocated_duration_sec > 0")


def latest_hour_batch(arrivals: DataFrame, received: str, keys: Sequence[str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """Newest arrival per key among the arrivals of the newest hour; older hours never fill in."""
    newest = arrivals.agg(F.date_trunc("hour", F.max(received)).cast(arrivals.schema[received].dataType).alias("h")).scalar()
    batch = arrivals.filter(F.col(received) >= newest)  # nothing is later than the newest hour
    order = [F.col(received).desc(), *[F.col(t) for t in tiebreak]]
    return keep_top(batch, keys, order)


def missing_keys(expected: DataFrame, arrived: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that did not arrive."""
    return expected.join(arrived.select(*keys).distinct(), list(keys), "left_anti")
