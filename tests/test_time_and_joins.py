"""As-of and banded joins, spines, interval splits, backlog, calendar."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orebook.functions import dates as DT
from orebook.operators import backlog as B
from orebook.operators import joins as J
from orebook.operators import machine as M
from orebook.operators import timegrid as G
from orebook.sources.tables import reference_table

D = lambda n: dt.date(2024, 1, n)


def test_asof_rate(spark):
    rates = reference_table(spark, [("EUR", D(2), 1.1), ("EUR", D(5), 1.2)], "ccy string, rate_date date, rate double")
    rows = [(1, "EUR", D(1)), (2, "EUR", D(2)), (3, "EUR", D(4)), (4, "EUR", D(6)), (5, "USD", D(1)), (6, "EUR", None), (7, "GBP", D(4))]
    df = spark.createDataFrame(rows, "id int, ccy string, d date")
    out = {r["id"]: r["rate"] for r in J.rate_enrich(df, rates, "ccy", "d", "USD").collect()}
    assert out == {1: None, 2: 1.1, 3: 1.1, 4: 1.2, 5: 1.0, 6: None, 7: None}


def test_asof_equals_range_join_and_lateral(spark):
    rng = random.Random(5)
    facts = spark.createDataFrame([(i, rng.choice("abc"), D(rng.randrange(1, 31))) for i in range(200)], "id int, k string, d date")
    hist = spark.createDataFrame([(k, D(n), n) for k in "ab" for n in (3, 9, 17, 25)], "k string, eff date, v int")
    got = {r["id"]: r["v"] for r in J.latest_effective(facts, hist, "k", "d", "eff", ["v"]).collect()}
    facts.createOrReplaceTempView("f"), hist.createOrReplaceTempView("h")
    by_max = spark.sql("select id, max_by(v, eff) v from f left join h on f.k = h.k and eff <= d group by id").collect()
    lateral = spark.sql("select id, x.v from f left join lateral (select v from h where h.k = f.k and eff <= d order by eff desc limit 1) x").collect()
    assert got == {r["id"]: r["v"] for r in by_max} == {r["id"]: r["v"] for r in lateral}


def test_effective_target(spark):
    t = spark.createDataFrame([("s", D(2), 10), ("s", D(4), 20)], "site string, eff date, target int")
    f = spark.createDataFrame([("s", D(1)), ("s", D(3)), ("s", D(4))], "site string, dt date")
    out = J.latest_effective(f, t, "site", "dt", "eff", ["target"]).orderBy("dt").collect()
    assert [r["target"] for r in out] == [None, 10, 20]


def test_top_band(spark):
    bands = reference_table(spark, [("s", 0.0, 0.0, 0), ("s", 0.8, 0.8, 1), ("s", 1.0, 1.0, 2)], "site string, band double, goal double, pay int")
    f = spark.createDataFrame([("s", 0.9), ("s", 1.0), ("s", None), ("t", 5.0), ("s", -1.0)], "site string, pct double")
    out = J.top_band(f, ["site"], bands, ["site"], "pct", "goal", "band", ["pay"]).collect()
    assert sorted(((r["site"], r["pct"], r["pay"]) for r in out), key=str) == sorted(
        [("s", 0.9, 1), ("s", 1.0, 2), ("s", None, None), ("t", 5.0, None), ("s", -1.0, None)], key=str
    )


def test_keep_top_limits_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as v")
    out = J.keep_top(df, ["k"], [F.col("v")])
    assert sorted(r["v"] for r in out.collect()) == [0, 1, 2]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_attach_dim_first_spelling_wins(spark):
    dim = spark.createDataFrame([("Ab", 1), ("AB", 2), ("x ", 3)], "item string, w int")
    f = spark.createDataFrame([("AB",), ("Ab",), ("x ",), ("q",)], "item string")
    raw = {r["item"]: r["w"] for r in J.attach_dim(f, dim, "item", "item", ["w"]).collect()}
    assert raw == {"AB": 2, "Ab": None, "x ": 3, "q": None}
    same = {r["item"]: r["w"] for r in J.attach_dim(f, dim, "item", "item", ["w"], normalise=True).collect()}
    assert same == {"AB": 2, "Ab": 2, "x ": 3, "q": None}


def test_backlog_of_hand_rows(spark):
    orders = spark.createDataFrame([("s", D(1), None), ("s", D(1), D(2)), ("s", D(2), D(1))], "site string, o date, i date")
    out = B.backlog_daily(orders, "site", "o", "i", D(3)).orderBy("dt").collect()
    assert [(r["dt"], r["new_orders"], r["shipped_orders"], r["open_orders"]) for r in out] == [(D(1), 2, 1, 2), (D(2), 1, 1, 1)]


def test_backlog_equals_the_naive_count(spark):
    rng = random.Random(9)
    day = lambda: None if rng.random() < 0.15 else D(rng.randrange(1, 29))
    rows = [(rng.choice(["a", "b", "none"]), day(), day()) for _ in range(300)] + [("empty", None, None)]
    rows = [(s, None if s == "none" else o, i) for s, o, i in rows]
    out = B.backlog_daily(spark.createDataFrame(rows, "site string, o date, i date"), "site", "o", "i", dt.date(2024, 2, 3), [D(15)])
    got = {(r["site"], r["dt"]): r for r in out.collect()}
    lo = min(o for _, o, _ in rows if o)
    days = [lo + dt.timedelta(days=n) for n in range((dt.date(2024, 2, 3) - lo).days)]
    assert set(got) == {(s, d) for s in ("a", "b", "none", "empty") for d in days}
    for (s, d), r in got.items():
        mine = [(o, i) for x, o, i in rows if x == s]
        assert r["new_orders"] == sum(o == d for o, _ in mine) and r["shipped_orders"] == sum(i == d for _, i in mine)
        assert r["open_orders"] == sum(o is not None and o <= d and (i is None or i > d) for o, i in mine)
        assert r["is_business_day"] == (d.weekday() < 5 and d != D(15))


def test_interval_split(spark):
    T = dt.datetime
    rows = [(1, T(2024, 1, 2, 1), 7200.0), (2, T(2024, 1, 2), 3600.0), (3, T(2024, 1, 2), 0.0), (4, T(2024, 1, 2), 20000.0), (5, None, 5.0)]
    df = spark.createDataFrame(rows, "id int, e timestamp_ntz, s double")
    out = [(r["id"], r["event_date"], float(r["allocated_duration_sec"])) for r in G.split_interval_by_day(df, "e", "s").collect()]
    assert sorted(out) == [(1, D(1), 3600.0), (1, D(2), 3600.0), (2, D(1), 3600.0)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_split_seconds_add_up_in_any_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rng = random.Random(2)
        rows = [(i, dt.datetime(2024, 3, 10) + dt.timedelta(seconds=rng.randrange(172800), microseconds=rng.randrange(10**6)), rng.randrange(1, 9999) / 7) for i in range(80)]
        df = spark.createDataFrame(rows, "id int, e timestamp_ntz, s double")
        sums = {r["id"]: r["x"] for r in G.split_interval_by_day(df, "e", "s").groupBy("id").agg(F.sum("allocated_duration_sec").alias("x")).collect()}
        assert all(abs(float(sums[i]) - s) < 1e-5 for i, _, s in rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_machine_dedup(spark):
    rows = [("d", 1, "Planned Stop", "x"), ("d", 1, "Run", "x"), ("d", 2, "Run", "Detecting State"), ("d", 2, "Odd", "x"), ("d", 3, "Run", None)]
    df = spark.createDataFrame(rows, "dev string, ev int, status string, state string")
    out = M.clean_events(df, ["dev", "ev"], "status", "state", ["status"]).collect()
    assert sorted((r["ev"], r["status"]) for r in out) == [(1, "Run"), (2, "Odd")]


def test_calendar_rule(spark):
    days = spark.sql("select explode(sequence(date'2024-12-30', date'2027-01-10', interval 1 day)) as calendar_date")
    cal = {r["calendar_date"]: r for r in G.calendar_445(G.fiscal_445(days)).collect()}
    at = lambda *d: (cal[dt.date(*d)]["fiscal_year"], cal[dt.date(*d)]["fiscal_month"], cal[dt.date(*d)]["fiscal_week"], cal[dt.date(*d)]["week_of_month"])
    assert at(2024, 12, 30) == (2025, 1, 1, 1)
    assert at(2025, 3, 24) == (2025, 3, 13, 5) and at(2025, 3, 31) == (2025, 4, 14, 1)
    assert at(2026, 12, 28) == (2027, 1, 1, 1) and at(2027, 1, 3) == (2027, 1, 1, 1) and at(2027, 1, 4) == (2027, 1, 1, 1)
    assert all((r["fiscal_month_end_date"] - r["fiscal_month_start_date"]).days < 35 for r in cal.values())
    r = cal[dt.date(2025, 2, 5)]
    assert (r["fiscal_yy_mm"], r["fiscal_mon_yyyy"], r["fiscal_month_start_date"], r["fiscal_week_end_date"]) == ("25-02", "Feb-2025", dt.date(2025, 1, 27), dt.date(2025, 2, 9))


def test_trailing_flags(spark):
    df = spark.createDataFrame([(D(30),), (D(24),), (D(23),), (dt.date(2023, 1, 30),), (dt.date(2023, 1, 29),), (None,)], "d date")
    out = df.select("d", *DT.trailing_flags(F.col("d"), D(31))).collect()
    assert [r["is_trailing_1wk"] for r in out] == [True, True, False, False, False, False]
    assert [r["is_ttm"] for r in out] == [True, True, True, True, False, False]


def test_latest_hour_batch_and_missing(spark):
    T = dt.datetime
    rows = [("a", "A", T(2024, 1, 1, 9, 10)), ("a", "A", T(2024, 1, 1, 9, 40)), ("a", "B", T(2024, 1, 1, 8, 59)), ("b", "B", T(2024, 1, 1, 9, 5))]
    df = spark.createDataFrame(rows, "type string, site string, ts timestamp_ntz")
    got = G.latest_hour_batch(df, "ts", ["type", "site"])
    assert sorted((r["type"], r["site"], r["ts"].minute) for r in got.collect()) == [("a", "A", 40), ("b", "B", 5)]
    want = spark.createDataFrame([("a", "A"), ("a", "B")], "type string, site string")
    assert [tuple(r) for r in G.missing_keys(want, got, ["type", "site"]).collect()] == [("a", "B")]
