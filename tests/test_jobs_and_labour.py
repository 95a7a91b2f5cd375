"""Routes, links, earned hours, payouts and payroll feeds."""

from pyspark.sql import functions as F

from orebook.operators import hours as H
from orebook.operators import jobs as JB
from orebook.operators import productivity as P
from orebook.operators import quality as Q
from orebook.sources.tables import reference_table


def test_route_attribution(spark):
    steps = spark.createDataFrame([(1, 10, "s"), (1, 20, "c"), (1, 30, "z"), (2, 10, "z")], "job int, seq int, code string")
    names = reference_table(spark, [("s", "S"), ("c", "C"), ("z", "Z")], "op_code string, op_name string")
    ranks = reference_table(spark, [("S", 3), ("C", 1)], "op_name string, rank int")
    out = {r["job"]: r for r in JB.route_attribution(steps, "job", "seq", "code", names, ranks).collect()}
    assert (out[1]["op_names"], out[1]["loss_op_code"], out[1]["loss_op_name"], out[1]["loss_rank"]) == ("S → C → Z", "c", "C", 1)
    assert out[2]["loss_op_name"] is None and out[2]["op_codes"] == "z"


def test_link_jobs(spark):
    rows = [(1, "5", "1", "1", "x"), (2, None, None, None, "7*2*3"), (3, None, None, None, "7*2*"), (4, None, None, None, "plain")]
    out = {r["job"]: r for r in JB.link_jobs(spark.createDataFrame(rows, "job int, o string, l string, s string, item string"), "o", "l", "s", "item").collect()}
    assert (out[1]["link_source"], out[1]["o"]) == ("default", "5")
    assert (out[2]["link_source"], out[2]["o"], out[2]["l"], out[2]["s"]) == ("assembly", "7", "2", "3")
    assert out[3]["link_source"] is None and out[3]["o"] is None and out[4]["o"] is None


def test_manual_hours_win(spark):
    rows = spark.createDataFrame([(1, "EXT", "A", 100.0, 5.0), (1, "CUT", "A", 100.0, 5.0), (1, "CUT", "A", 100.0, 2.0)], "job int, op string, site string, qty double, hrs double")
    manual = reference_table(spark, [(1, "EXT", 9.0)], "job int, op string, manual_hrs double")
    include = reference_table(spark, [("A", "CUT", True)], "site string, op string, include boolean")
    formulas = [(F.col("op") == "EXT", F.col("qty") * 0.0125)]
    out = {r["op"]: r for r in JB.earned_hours(rows, "job", "op", "site", "qty", "hrs", formulas, manual, include).collect()}
    assert (out["EXT"]["calc_hours"], out["EXT"]["earned_hours"], out["EXT"]["manual_adjusted"], out["EXT"]["calc_adjusted"]) == (1.25, 9.0, True, True)
    assert (out["CUT"]["earned_hours"], out["CUT"]["include"], out["EXT"]["include"]) == (7.0, True, None)


def test_payout_override_and_zero_hours(spark):
    worked = spark.createDataFrame([("C", "A", 2025, 1, 1.0, 0.0, 100.0), ("C", "A", 2025, 2, 0.0, 0.0, 0.0)], "country string, site string, year int, month int, worked_regular_hrs double, worked_overtime_hrs double, worked_total_hrs double")
    earned = spark.createDataFrame([("A", 2025, 1, 100.0)], "site string, year int, month int, earned_hours double")
    timing = reference_table(spark, [(2025, 1, 2024), (2025, 2, 2025)], "year int, month int, target_year int")
    bands = reference_table(spark, [("A", 2024, 0.8, 0.8, 1.0, "hrs"), ("A", 2024, 1.0, 1.0, 2.0, "hrs"), ("A", 2025, 0.0, 0.0, 0.0, "hrs")], "site string, year int, band_pct double, goal_pct double, payout_usd double, uom string")
    over = reference_table(spark, [("A", 2025, 2, 7.0)], "site string, year int, month int, payout_usd double")
    out = {r["month"]: r for r in P.banded_payout(worked, earned, timing, bands, over).collect()}
    assert (out[1]["band_pct"], out[1]["payout_usd"], out[1]["target_pct"]) == (1.0, 2.0, 1.0)
    assert (out[2]["productivity_pct"], out[2]["band_pct"], out[2]["payout_usd"]) == (None, None, 7.0)
    people = spark.createDataFrame([("A", 2025, 1, "Ann", 10.0), ("A", 2025, 1, "TEMP", 10.0), ("B", 2025, 1, "Bo", 3.0)], "site string, year int, month int, employee_name string, total_hrs double")
    pay = {r["employee_name"]: r["month_bonus"] for r in P.employee_payout(people, P.banded_payout(worked, earned, timing, bands, over)).collect()}
    assert pay == {"Ann": 20.0, "TEMP": 0.0, "Bo": 0.0}


def test_pay_codes_without_double_time(spark):
    raw = spark.createDataFrame([("g/c/Site One/d", "DOE JO (12)", "Regular", "8", 2025, 1), ("g/c/Site One/d", "DOE JO (12)", "Overtime", "bad", 2025, 1), ("g/c/Nowhere/d", "X (1)", "Regular", "5", 2025, 1)], "location string, employee string, pay_code string, hours string, year int, month int")
    sites = reference_table(spark, [("Site One", "S1", "US")], "site_name string, site string, country string")
    (r,) = H.pay_code_feed(raw, sites).collect()
    assert (r["employee_id"], r["employee_name"], r["regular_hrs"], r["overtime_hrs"], r["total_hrs"]) == ("12", "DOE JO", 8.0, 0.0, 8.0)


def test_temp_feed_adds_the_weeks_of_a_month(spark):
    raw = spark.createDataFrame([("Hours", "x", "x", "x"), ("Reg", "10", "5", "bad"), ("OT", "1", None, "2")], "label string, `W1-Jan` string, `W2-Jan` string, `W1-Feb` string")
    out = {r["month"]: (r["regular_hrs"], r["overtime_hrs"], r["employee_name"]) for r in H.temp_feed(raw, "label", "Reg", "OT", 2025, "US", "S1").collect()}
    assert out == {1: (15.0, 1.0, "TEMP"), 2: (0.0, 2.0, "TEMP")}


def test_plan_feed_changes_its_filter(spark):
    cols = "month string, location string, employee_name string, employee_id string, plan string, department string, dept_code string, worked string, overtime string"
    rows = [("2025-03-01", "L", "a", "7.0", "X", "Plant - Processing", "1", "10", "2"), ("2025-03-01", "L", "b", "8.0", "PIP", "Office", "1", "10", "2"), ("2026-03-01", "L", "c", None, "PIP", "Office", "1", "10", None)]
    out = {r["employee_name"]: r for r in H.plan_feed(spark.createDataFrame(rows, cols), reference_table(spark, [("L", "S", "MX")], "site_name string, site string, country string")).collect()}
    assert set(out) == {"a", "c"} and out["a"]["employee_id"] == "7 - X" and out["c"]["employee_id"] == "0 - PIP"
    assert (out["a"]["regular_hrs"], out["c"]["regular_hrs"]) == (8.0, 10.0)


def test_safe_integers(spark):
    df = spark.createDataFrame([("1", "01", "9007199254740993", "1"), ("-20", "2", "5", "x"), (None, None, None, None)], "a string, b string, c string, d string")
    out = Q.convert_integer_text(df, ["a", "b", "c", "d"])
    assert dict(out.dtypes) == {"a": "bigint", "b": "string", "c": "string", "d": "string"}


def test_schema_contract(spark):
    import pytest

    df = spark.range(1)
    assert Q.schema_contract(df, ["id"]) is df
    with pytest.raises(ValueError):
        Q.schema_contract(df, ["id", "x"])
