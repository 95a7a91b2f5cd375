"""Lists, frames, distinct counts, as-of values and fused aggregates where one group holds most rows."""

import bisect
import datetime as dt
import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import queries
from orebook.operators import joins as J
from orebook.operators import rollup as R
from orebook.operators.running import trailing_sums



def order():
    return [F.col("day").asc_nulls_last(), F.col("id")]


def chunks():
    return [F.col("day"), F.shiftright("id", 3)]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(41)
    made = [("hot" if draw.random() < 0.6 else draw.choice("abc"), dt.date(2024, 1, draw.randint(1, 9)) if draw.random() < 0.95 else None, i,
             draw.choice([None, 1, 2, 5, 900]), draw.choice([0, 7, 7, 40_000, 70_000, None]), draw.choice("RAN")) for i in range(700)]
    made += [(None, dt.date(2024, 1, 1), 700 + i, 1, 1, "R") for i in range(5)]
    return made, spark.createDataFrame(made, "k string, day date, id long, v int, item long, flag string").repartition(5)


@pytest.mark.parametrize("large_rows", [50, 10**6])
def test_segments_hold_ordered_lists(rows, large_rows):
    made, df = rows
    out = R.list_segments(df, ["k"], order(), chunks(), [F.col("id"), F.col("v")], 20, large_rows).collect()
    assert max(r.n for r in out) == 20 and all(len(r["items"]) == r.n for r in out)
    for k in ("hot", "a", "b", "c", None):
        want = [(r[2], r[3]) for r in sorted((r for r in made if r[0] == k), key=lambda r: (r[1] or dt.date.max, r[2]))]
        mine = sorted((r for r in out if r.k == k), key=lambda r: r.segment)
        assert [r.segment for r in mine] == list(range(len(mine)))
        assert [(x.id, x.v) for r in mine for x in r["items"]] == want
    assert R.list_segments(df.limit(0), ["k"], order(), chunks(), [F.col("id")], 20).count() == 0


@pytest.mark.parametrize("frame", [1, 2, 12])
def test_trailing_sums_equal_the_plain_window(rows, frame):
    _, df = rows
    got = trailing_sums(df, ["k"], order(), {"s": F.col("v"), "n": F.col("item")}, chunks(), frame, block_rows=11, large_rows=50)
    plain = Window.partitionBy("k").orderBy(*order()).rowsBetween(1 - frame, 0)
    want = df.withColumns({"s": F.sum("v").over(plain), "n": F.sum("item").over(plain)})
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    with pytest.raises(ValueError):
        trailing_sums(df, ["k"], order(), {"s": F.col("v")}, chunks(), 13, block_rows=11)


def kinds():
    return {"items": F.lit(True), "r": F.col("flag") == "R", "big": F.col("item") > 30_000}


def brute_counts(made, key):
    out = {}
    for row in made:
        item, flag, seen = row[4], row[5], out.setdefault(key(row), ({}))
        if item is not None:
            for n, is_one in (("items", True), ("r", flag == "R"), ("big", item > 30_000)):
                if is_one:
                    seen.setdefault(n, set()).add(item)
    return {k: tuple(len(v.get(n, ())) for n in ("items", "r", "big")) for k, v in out.items()}


def test_distinct_counts_at_two_grains_without_expand(rows):
    made, df = rows
    by_day, by_key = brute_counts(made, lambda r: (r[0], r[1])), brute_counts(made, lambda r: r[0])
    flags = R.distinct_flags(df, ["k", "day"], "item", kinds())
    maps = R.distinct_bitmaps(df, ["k", "day"], "item", kinds())
    direct = R.count_distinct_by(df, ["k"], "item", "items", {n: c for n, c in kinds().items() if n != "items"})
    for keys, want in ((["k", "day"], by_day), (["k"], by_key)):
        flat = R.count_flags(flags, keys, "item", "total", list(kinds()))
        for frame in (flat.drop("total"), R.count_bitmaps(maps, keys, list(kinds()))):
            assert "Expand" not in frame._jdf.queryExecution().executedPlan().toString()
            got = {(r.k, r.day) if len(keys) == 2 else r.k: (r["items"], r.r, r.big) for r in frame.collect()}
            assert got == {k: v for k, v in want.items() if v[0]}
    assert {r.k: (r["items"], r.r, r.big) for r in direct.collect()} == by_key
    assert "Expand" not in direct._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("minutes", [1, 60, 10**6])
def test_asof_by_time_with_one_hot_key(spark, minutes):
    draw = random.Random(42)
    start = dt.datetime(2024, 1, 1)
    when = lambda: start + dt.timedelta(seconds=draw.randint(0, 40_000))
    key = lambda: "hot" if draw.random() < 0.9 else draw.choice(["a", "b", None])
    facts = [(i, key(), when() if draw.random() < 0.97 else None) for i in range(900)]
    history = [(key(), when(), draw.choice([None, 1, 2, 3])) for _ in range(120)] + [("late", start + dt.timedelta(days=9), 1), ("hot", None, 9)]
    history += [("hot", history[0][1], 5)]
    known: dict = {}
    for k, at, v in history:
        if at is not None:
            known.setdefault(k, {}).setdefault(at, []).append(v)
    left = spark.createDataFrame(facts, "i long, k string, at timestamp_ntz")
    right = spark.createDataFrame(history, "k string, since timestamp_ntz, v int")
    chunk = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / (60 * minutes))
    got = {r.i: (r.since, r.v) for r in J.asof_join(left, right, "k", "at", "since", ["v"], chunk).collect()}
    assert len(got) == len(facts)
    for i, k, at in facts:
        times = sorted(known.get(k, {})) if k is not None else []
        n = bisect.bisect_right(times, at) if at is not None else 0
        want = (times[n - 1], max((v for v in known[k][times[n - 1]] if v is not None), default=None)) if n else (None, None)
        assert got[i] == want, (k, at)
    chunks = J.asof_values_chunked(left, right, "k", "at", "since", ["v"], chunk)
    assert "rangepartitioning" not in chunks._jdf.queryExecution().executedPlan().toString()


def scans(df, table):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(f"{table}.parquet" in line for line in plan.split("\n") if "Scan parquet" in line)


@pytest.mark.parametrize("key, most", [("op_yield_metrics_bom_basis", 1), ("op_yield_final", 1), ("op_yield_site_op_date", 1), ("op_order_job_link", 2)])
def test_lines_are_read_once_per_fact(spark, sf_dir, key, most):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        assert 1 <= scans(queries()[key](spark, sf_dir), "lineitem") <= most
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_segments_as_json_are_readable(spark, sf_dir):
    lists = queries()["agg_json_array_segments"](spark, sf_dir).limit(20).collect()
    assert all(len(json.loads(r.details)) == r.n <= 25 for r in lists)


def test_large_tables_raise_the_shuffle_partitions(spark, sf_dir, monkeypatch):
    from orebook import session
    from orebook.sources import tables

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        orders = tables.Tables(spark, sf_dir).orders
        size = session.stored_bytes(orders)
        assert 0 < size < 2**27 and spark.conf.get("spark.sql.shuffle.partitions") == before
        monkeypatch.setattr(tables, "stored_bytes", lambda df: 1000 * 2**27)
        tables.Tables(spark, sf_dir)["orders"]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1000"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
