"""Payroll feeds of five kinds to one schema of worked hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebook.functions.dates import MONTH_NUMBER, MONTHS
from orebook.functions.numbers import coerce
from orebook.functions.text import extract_or_null, id_text, lookup
from orebook.operators.rollup import melt_pairs, pivot_fixed, stack

STANDARD = ("country", "site", "year", "month", "employee_id", "employee_name", "dept_code",
            "regular_hrs", "overtime_hrs", "total_hrs")
PERSON = STANDARD[:7]
# Pay codes, the department label and the identity of pooled temporary staff.
PAY_CODES = {"Regular": "regular_hrs", "Overtime": "overtime_hrs", "Doubletime": "doubletime_hrs"}
PLANT_DEPT = "110/120"
TEMP_ID, TEMP_NAME = "999999", "TEMP"
LONG_DEPTS = ("120", "121")
WIDE_DEPT = "120"
PLAN_SINCE, PLAN, PLAN_DEPT = 2026, "PIP", "Plant - Processing"


def pay_code_feed(raw: DataFrame, sites: DataFrame, add_as: str = "double") -> DataFrame:
    """Monthly detail by pay code: location path, ``NAME (id)``; double time counts as overtime.

    ``raw`` has (location, employee, pay_code, hours, year, month); ``sites`` (site_name, site, country).
    ``add_as`` is the type hours are added in.
    """
    who = F.col("employee")
    rows = raw.select(
        F.split(F.col("location"), "/").getItem(2).alias("site_name"), "year", "month",
        extract_or_null(who, r"\((\d+)\)").alias("employee_id"),
        extract_or_null(who, r"^(.*) \(\d+\)").alias("employee_name"),
        F.lit(PLANT_DEPT).alias("dept_code"), "pay_code", coerce(F.col("hours")).cast(add_as).alias("hours"),
    )
    known = rows.join(sites, "site_name").filter(F.col("employee_id").isNotNull() & F.col("employee_name").isNotNull())
    wide = pivot_fixed(known, PERSON, "pay_code", PAY_CODES, F.col("hours"))
    wide = wide.withColumns({
        "regular_hrs": F.col("regular_hrs").cast("double"),
        "overtime_hrs": (F.col("overtime_hrs") + F.col("doubletime_hrs")).cast("double"),
    })
    return wide.withColumn("total_hrs", F.col("regular_hrs") + F.col("overtime_hrs")).select(*STANDARD)


def temp_feed(raw: DataFrame, label: str, regular: str, overtime: str, year: int, country: str, site: str,
              add_as: str = "double") -> DataFrame:
    """Labelled rows by ``W1-Jan`` columns, transposed and summed by month."""
    periods = [c for c in raw.columns if c != label]
    long = raw.unpivot([label], periods, "period", "hours").filter(F.col(label).isin(regular, overtime))
    hours, zero = coerce(F.col("hours")).cast(add_as), F.lit(0)
    month = lookup(F.split("period", "-").getItem(1), MONTH_NUMBER)
    by_month = long.groupBy(month.alias("month")).agg(
        F.sum(F.when(F.col(label) == regular, hours).otherwise(zero)).cast("double").alias("regular_hrs"),
        F.sum(F.when(F.col(label) == overtime, hours).otherwise(zero)).cast("double").alias("overtime_hrs"),
    ).filter("month is not null")
    return by_month.select(
        F.lit(country).alias("country"), F.lit(site).alias("site"), F.lit(year).alias("year"), "month",
        F.lit(TEMP_ID).alias("employee_id"), F.lit(TEMP_NAME).alias("employee_name"), F.lit(PLANT_DEPT).alias("dept_code"),
        "regular_hrs", "overtime_hrs", (F.col("regular_hrs") + F.col("overtime_hrs")).alias("total_hrs"),
    )


def wide_feed(raw: DataFrame, ids: dict[str, str], year: int, country: str, site: Column, dept: str = WIDE_DEPT,
              overtime_suffix: str = ".1", department: str | None = None) -> DataFrame:
    """Twelve regular and twelve overtime columns per employee to one row per month.

    Rows of the department ``dept`` are kept, told by the digits its field begins with; where
    ``department`` is given, they are told by that text and get ``dept`` as their code. ``site``
    may be a column, such as one looked up by the row's location.
    """
    named = raw.select(
        *[F.col(f"`{src}`").alias(dst) for src, dst in ids.items()],
        *[F.col(f"`{m}`") for m in MONTHS], *[F.col(f"`{m}{overtime_suffix}`") for m in MONTHS], site.alias("site"),
    )
    if department is None:
        named = named.withColumn("dept_code", extract_or_null(F.col("dept_code"), r"(^\d+)")).filter(F.col("dept_code") == dept)
    else:
        named = named.filter(F.col("dept_code") == department).withColumn("dept_code", F.lit(dept))
    long = melt_pairs(
        named, ["site", *ids.values()], {n: m for m, n in MONTH_NUMBER.items()},
        {n: f"{m}{overtime_suffix}" for m, n in MONTH_NUMBER.items()}, "reg", "ot",
    )
    regular, overtime = coerce(F.col("reg")), coerce(F.col("ot"))
    return long.select(
        F.lit(country).alias("country"), "site", F.lit(year).alias("year"), "month",
        id_text(F.col("employee_id")).alias("employee_id"), "employee_name", "dept_code",
        regular.alias("regular_hrs"), overtime.alias("overtime_hrs"), (regular + overtime).alias("total_hrs"),
    )


def branch_feed(raw: DataFrame, country: str, branches: dict[int, str], depts: Sequence[str] = LONG_DEPTS) -> DataFrame:
    """One row per employee and month with a branch number; total and overtime given."""
    total, overtime = coerce(F.col("worked")), coerce(F.col("overtime"))
    return raw.filter(F.col("dept_code").isin(*depts)).select(
        F.lit(country).alias("country"), lookup(F.col("branch").try_cast("double").cast("int"), branches).alias("site"),
        F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"),
        F.col("employee_id").cast("string").alias("employee_id"), "employee_name", "dept_code",
        (total - overtime).alias("regular_hrs"), overtime.alias("overtime_hrs"), total.alias("total_hrs"),
    )


def plan_feed(raw: DataFrame, sites: DataFrame, since: int = PLAN_SINCE) -> DataFrame:
    """One row per employee and month date; the filter column changes with the year."""
    total, overtime = coerce(F.col("worked")), coerce(F.col("overtime"))
    day = F.col("month").cast("date")
    wanted = F.when(F.year(day) < since, F.col("department") == PLAN_DEPT).otherwise(F.col("plan") == PLAN)
    rows = raw.filter(wanted).join(sites, raw["location"] == sites["site_name"], "left")
    number = F.coalesce(F.col("employee_id").cast("double"), F.lit(0.0)).cast("bigint").cast("string")
    return rows.select(
        "country", "site", F.year(day).alias("year"), F.month(day).alias("month"),
        F.concat(number, F.lit(" - "), F.col("plan")).alias("employee_id"), "employee_name", "dept_code",
        (total - overtime).alias("regular_hrs"), overtime.alias("overtime_hrs"), total.alias("total_hrs"),
    )


def standardise(feeds: Sequence[DataFrame]) -> DataFrame:
    """All feeds in the standard columns, rows without hours dropped."""
    typed = [f.select(*[F.col(c).cast("int") if c in ("year", "month") else F.col(c) for c in STANDARD]) for f in feeds]
    return stack(typed).filter("total_hrs != 0")
