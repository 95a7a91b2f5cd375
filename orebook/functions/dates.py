"""Dates: fiscal labels, trailing windows, weekday and age tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trailing windows in days.
TRAILING_DAYS = {"1wk": 7, "2wk": 14, "4wk": 28, "8wk": 56, "12wk": 84, "26wk": 182}
# Month names.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTH_NUMBER = {name: n for n, name in enumerate(MONTHS, start=1)}


def is_weekday(d: Column) -> Column:
    return ~F.dayofweek(d).isin(1, 7)


def period_key(year: Column, part: Column) -> Column:
    return year * 100 + part


def fiscal_labels(year: Column, month: Column, month_name: Column) -> list[Column]:
    y, m = year.cast("string"), F.lpad(month.cast("string"), 2, "0")
    yy, mon = F.right(y, F.lit(2)), F.left(month_name, F.lit(3))
    dash = F.lit("-")
    return [
        F.concat(yy, dash, m).alias("fiscal_yy_mm"),
        F.concat(y, dash, m).alias("fiscal_yyyy_mm"),
        F.concat(mon, dash, yy).alias("fiscal_mon_yy"),
        F.concat(mon, dash, y).alias("fiscal_mon_yyyy"),
    ]


def trailing_flags(d: Column, as_of: dt.date) -> list[Column]:
    """Whether ``d`` lies in each window that ends the day before ``as_of``; a null date is in none."""
    run = F.date_sub(F.lit(as_of), 1)
    flags = [
        F.coalesce(d.between(F.date_sub(run, n - 1), run), F.lit(False)).alias(f"is_trailing_{label}")
        for label, n in TRAILING_DAYS.items()
    ]
    flags.append(F.coalesce(d.between(F.add_months(run, -12), run), F.lit(False)).alias("is_ttm"))
    return flags


def lead_time_bucket(d: Column, as_of: Column, days: int = 7) -> Column:
    return F.when(F.datediff(as_of, d) < days, F.lit("in_lead_time")).otherwise(F.lit("out_of_lead_time"))


def seconds_before(ts: Column, seconds: Column) -> Column:
    """A timestamp moved back by a number of seconds, kept to the microsecond."""
    return ts - F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end`` as a decimal with six places, in any session time zone."""
    gap = end - start
    whole = (
        F.extract(F.lit("DAY"), gap) * 86400 + F.extract(F.lit("HOUR"), gap) * 3600
        + F.extract(F.lit("MINUTE"), gap) * 60
    )
    return (whole.cast("decimal(12,0)") + F.extract(F.lit("SECOND"), gap)).cast("decimal(18,6)")


def overlap_seconds(start: Column, end: Column, day: Column) -> Column:
    """Seconds of ``[start, end)`` that fall on ``day``."""
    begin = day.cast("timestamp_ntz")
    return seconds_between(F.greatest(start, begin), F.least(end, begin + F.expr("interval 1 day")))
