"""Running totals, allocation and cross-site cover on hand rows and against brute force."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orebook.operators import allocation as A
from orebook.operators import running
from orebook.operators.running import large_groups, running_totals

D = lambda n: dt.date(2024, 1, n)
SITES = ("A", "B")
LINES = [  # item, site, promise, order, quantity
    ("X", "A", D(1), 1, 60), ("X", "A", D(2), 2, 60), ("X", "B", D(3), 3, 20), ("X", "A", None, 4, 10), ("X", "Z", D(1), 5, 5),
]


def lines_df(spark, rows=LINES):
    return spark.createDataFrame(
        [(i, s, d, o, None if q is None else Decimal(q), "PCS") for i, s, d, o, q in rows],
        "item string, site string, promise date, nbr int, required decimal(8,2), unit string",
    )


def tally(spark, rows=LINES, stock=(("X", "A", 100), ("X", "B", 50)), large_rows=1_000_000):
    on_hand = spark.createDataFrame([(i, s, Decimal(q)) for i, s, q in stock], "item string, site string, on_hand decimal(8,2)")
    wide = A.stock_by_site(on_hand, "item", "site", "on_hand", SITES)
    order = [F.col("promise").asc_nulls_last(), F.col("nbr")]
    return A.allocation_tally(lines_df(spark, rows), wide, SITES, "item", "site", "required", order, [F.col("promise"), F.shiftright("nbr", 1)],
                              large_rows=large_rows)


@pytest.mark.parametrize("large_rows", [1_000_000, 1])
def test_tally_of_hand_rows(spark, large_rows):
    got = {r["nbr"]: r for r in tally(spark, large_rows=large_rows).collect()}
    want = {1: (40, 50, 40, False), 5: (40, 50, None, None), 2: (-20, 50, -20, True), 3: (-20, 30, 30, False), 4: (-30, 30, -30, True)}
    for nbr, (a, b, home, short) in want.items():
        r = got[nbr]
        assert (r["tally_A"], r["tally_B"], r["tally_home"], r["is_short"]) == (a, b, home, short), nbr
        assert (r["floor_A"], r["floor_B"]) == (-30, 30)


@pytest.mark.parametrize("large_rows", [1_000_000, 0])
def test_cross_site_cover_of_hand_rows(spark, large_rows):
    out = A.cross_site_match(tally(spark), SITES, "item", "site", "required", "unit", [F.col("nbr")], [F.shiftright("nbr", 1)], large_rows=large_rows)
    (r,) = out.collect()
    assert (r["short_site"], r["donor_site"], r["lines_short"], r["lines_coverable"]) == ("A", "B", 2, 1)
    assert (r["total_short_qty"], r["donor_available_qty"], r["qty_needed"]) == (70, 30, 10)
    assert (r["lines_coverage_pct"], r["full_lines_cover"], r["donor_overcommitted"]) == (50.0, False, True)


def test_cross_site_cover_against_brute_force(spark):
    rng = random.Random(3)
    sites = ("A", "B")
    rows = [(f"i{rng.randrange(4)}", rng.choice(sites + ("Z",)), D(rng.randrange(1, 20)), n, rng.randrange(0, 30)) for n in range(120)]
    stock = [(f"i{k}", s, rng.randrange(100, 420)) for k in range(4) for s in sites]
    t = tally(spark, rows, stock)
    per_line = [r.asDict() for r in t.collect()]
    out = A.cross_site_match(t, sites, "item", "site", "required", "unit", [F.col("nbr")], [F.shiftright("nbr", 3)], large_rows=5)
    got = {(r["item"], r["short_site"], r["donor_site"]): (r["lines_coverable"], r["qty_needed"]) for r in out.collect()}
    want = {}
    for item, short, donor in itertools.product({r["item"] for r in per_line}, sites, sites):
        mine = sorted(((r["required"], r["nbr"]) for r in per_line if r["item"] == item and r["site"] == short and r["is_short"]))
        floors = {r[f"floor_{donor}"] for r in per_line if r["item"] == item and r["site"] == donor}
        if short == donor or not mine or not floors or min(floors) <= 0:
            continue
        n, total = 0, Decimal(0)
        for q, _ in mine:
            if total + q > min(floors):
                break
            n, total = n + 1, total + q
        want[item, short, donor] = (n, total)
    assert got == want and want


@pytest.mark.parametrize("large_rows", [1_000_000, 40, 0])
def test_running_totals_equal_the_plain_sum(spark, large_rows):
    """One group has a third of all rows, one is null, values may be negative, dates may be missing."""
    rng = random.Random(11)
    rows = []
    for n in range(600):
        g = "hot" if n % 3 == 0 else rng.choice(["a", "b", "c", None])
        d = None if rng.random() < 0.1 else D(rng.randrange(1, 28)) if rng.random() < 0.7 else D(5)
        rows.append((g, d, n, rng.randrange(-5, 20)))
    df = spark.createDataFrame(rows, "g string, d date, n int, v bigint")
    out = running_totals(df, ["g"], [F.col("d").asc_nulls_last(), F.col("n")], {"run": F.col("v")}, [F.col("d"), F.shiftright("n", 4)],
                         totals=True, peaks=True, large_rows=large_rows)
    got = {r["n"]: (r["run"], r["run_total"], r["run_peak"]) for r in out.collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or D(1), r[2]))
        sums = list(itertools.accumulate(r[3] for r in mine))
        for r, s in zip(mine, sums):
            assert got[r[2]] == (s, sums[-1], max(sums)), (g, r)


def test_chunked_window_is_not_by_group(spark):
    """The rows of a large group are shuffled by chunk."""
    df = spark.range(1000).selectExpr("'hot' as g", "id as n", "1L as v")
    out = running_totals(df, ["g"], [F.col("n")], {"run": F.col("v")}, [F.shiftright("n", 5)], large_rows=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__chunk" in plan and "Window" in plan
    assert out.agg(F.max("run")).first()[0] == 1000


def test_large_groups_are_listed(spark):
    df = spark.range(100).selectExpr("if(id < 60, 'x', cast(id as string)) as g")
    assert [r["g"] for r in large_groups(df, ["g"], 50).collect()] == ["x"]
    assert large_groups(df, ["g"]).isEmpty()


def test_one_count_serves_many(spark, monkeypatch):
    df = spark.range(1000).selectExpr("if(id < 600, 'x', cast(id as string)) as g", "id as n", "id % 3 as site", "1L as v")
    counted = []
    monkeypatch.setattr(running, "large_groups", lambda *a: counted.append(a[1]) or large_groups(*a))
    small, busy = running.GroupSizes(df, ["g"]), running.GroupSizes(df, ["g"], 100)
    totals = lambda sizes, keys: sorted(running_totals(
        df, keys, [F.col("n")], {"run": F.col("v")}, [F.shiftright("n", 5)], sized_by=sizes).collect())
    for keys in (["g"], ["g", "site"]):
        assert totals(small, keys) == totals(busy, keys)
    assert counted == [["g"]] and small.large is None and [r["g"] for r in busy.large.collect()] == ["x"]


def test_many_large_groups_and_equal_schemas(spark):
    """Twenty groups above a tiny threshold, decimals: both ways give the same rows and types."""
    df = spark.range(2000).selectExpr("id % 20 as g", "id as n", "cast(id % 7 as decimal(18,2)) as v")
    both = [running_totals(df, ["g"], [F.col("n")], {"run": F.col("v")}, [F.shiftright("n", 5)], totals=True, peaks=True, large_rows=rows)
            for rows in (5, 10_000)]
    assert both[0].schema.simpleString() == both[1].schema.simpleString()
    assert sorted(both[0].collect()) == sorted(both[1].collect())


def test_conservation(spark):
    """The last home balance of an item and site is its stock less all demand."""
    t = tally(spark)
    last = t.filter("site = 'A'").orderBy(F.col("promise").desc_nulls_first(), F.desc("nbr")).first()
    assert last["tally_A"] == 100 - (60 + 60 + 10)


def test_empty_lines(spark):
    assert tally(spark, rows=[]).count() == 0


def test_status_order(spark):
    rows = [(True, 0, "Complete,Closed", None), (True, 0, "Released", None), (True, 5, None, True), (True, 5, None, False), (True, None, None, None), (False, 5, None, True)]
    df = spark.createDataFrame(rows, "scope boolean, req int, job string, short boolean")
    out = df.select(A.pipeline_status(F.col("scope"), F.col("req"), F.col("job"), F.col("short")).alias("s")).collect()
    assert [r["s"] for r in out] == ["Job Complete", "Job Started", "No Material", "Material Available", "Unknown", None]


def test_net_available_keeps_positive_balances(spark):
    have = spark.createDataFrame([("i", "S", 10), ("i", "T", 3)], "item string, site string, q int")
    need = spark.createDataFrame([("i", "S", 4), ("i", "S", None), ("i", "T", 3)], "item string, site string, r int")
    out = A.net_available(have, need, ["item", "site"], "q", "r").collect()
    assert [(r["site"], r["net_available"]) for r in out] == [("S", 6)]
