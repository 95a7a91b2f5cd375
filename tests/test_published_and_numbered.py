"""Title rows by count, many snapshots in one scan, published versions, keyed replacement, uniqueness by hash."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orebook.operators import quality as Q
from orebook.sinks.published import PublishedTable
from orebook.sources import numbered as N


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("skip", [0, 1, 7])
@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_title_rows_by_number_in_files_of_several_splits(spark, tmp_path, small_splits, skip, encoding):
    titles = ["", "a,b,c", "1,2", '"x, y"', "", "é", "b,a"][7 - skip:] if skip else []
    want = []
    for name, head in (("one", "a,b"), ("two", " b ,stray,a"), ("empty", "a,b")):
        rows = [] if name == "empty" else [(f"{name}{i}", f'é, "{i}"' if i % 3 else "N/A") for i in range(60)]
        text = lambda a, b: '"' + b.replace('"', '""') + '"' if b != "N/A" else b
        lines = [f"{a},{text(a, b)}" if name != "two" else f"{text(a, b)},z,{a}" for a, b in rows]
        (tmp_path / f"{name}.csv").write_bytes("\r\n".join([*titles, head, *lines, "", ""]).encode(encoding))
        want += [(a, None if b == "N/A" else b) for a, b in rows]
    lines = N.numbered_lines(spark, f"{tmp_path}/*.csv", encoding)
    assert spark.read.text(f"{tmp_path}/*.csv").rdd.getNumPartitions() > 6
    numbers = [r.number for r in lines.filter("`__file` like '%one.csv'").collect()]
    assert sorted(numbers) == list(range(len(numbers)))
    got = N.read_csv_skipping(spark, f"{tmp_path}/*.csv", skip, ["a", " b"], encoding).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        N.read_csv_skipping(spark, f"{tmp_path}/*.csv", skip, ["a", "nowhere"], encoding)
    with pytest.raises(FileNotFoundError):
        N.read_csv_skipping(spark, f"{tmp_path}/none*.csv", skip, ["a"])


def test_five_hundred_snapshots_in_a_plan_of_constant_size(spark, tmp_path):
    draw = random.Random(51)
    heads = {"Order Line,Reason": lambda i: f"{i},r{i}", "reason,stray,ORDER LINE": lambda i: f"r{i},s,{i}", "Order-Line": lambda i: f"{i}", "order line , ": lambda i: f"{i},r{i}"}
    want, sizes = [], []
    for many in (5, 500):
        folder = tmp_path / str(many)
        folder.mkdir()
        want = []
        for n in range(many):
            head = draw.choice(list(heads))
            day = dt.date(2024, 1, 1) + dt.timedelta(days=n)
            (folder / f"{day:%m.%d.%y}.csv").write_text("\n".join(["title", head, *(heads[head](i) for i in range(3))]))
            want += [(str(i), None if head == "Order-Line" else f"r{i}", f"{day:%m.%d.%y}", day) for i in range(3)]
        out = N.read_snapshots(spark, f"{folder}/*.csv", ["Order Line", "Reason"], lambda f: F.regexp_extract(f, r"([^/]*)\.csv$", 1), skip=1)
        sizes.append(out._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert sizes[0] == sizes[1]


def test_versions_survive_a_failing_write(spark, tmp_path):
    table = PublishedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.range(10).withColumn("v", F.lit(1)))
    bad = spark.range(20).withColumn("v", F.expr("if(id = 19, raise_error('stopped'), 2)"))
    for write in (table.replace, table.truncate, table.append):
        with pytest.raises(Exception, match="stopped"):
            write(bad)
        assert sorted(map(tuple, table.read().collect())) == [(i, 1) for i in range(10)]
    assert table.version() == 1
    table.truncate(spark.range(2).withColumn("more", F.lit(2.5)))
    assert sorted(map(tuple, table.read().collect())) == [(0, None, "2.5"), (1, None, "2.5")]
    table.append(spark.range(2, 3))
    assert sorted(map(tuple, table.read().select("id", "more").collect())) == [(0, "2.5"), (1, "2.5"), (2, None)]
    assert table.read(1).count() == 10  # earlier versions stay readable


def test_the_second_of_two_writers_fails(spark, tmp_path):
    one, two = (PublishedTable(spark, str(tmp_path / "t")) for _ in "ab")
    one.replace(spark.range(1))
    stale = two.version() + 1
    one.append(spark.range(1, 2))
    with pytest.raises(RuntimeError):
        two._publish(stale, {})
    assert one.read().count() == 2


@pytest.mark.parametrize("partition", [None, "day"])
def test_merge_equals_delete_and_insert(spark, tmp_path, partition):
    draw = random.Random(52)
    table, rows = PublishedTable(spark, str(tmp_path / "t"), partition), []
    fields = "day date, site string, bucket int, n long"
    some = lambda n: [(draw.choice([None, *(dt.date(2024, 1, d) for d in range(1, 6))]), draw.choice(["a", "b", None]), draw.randint(0, 3), draw.randint(0, 99)) for _ in range(n)]
    untouched = set()
    for step, load in enumerate([some(30), some(5), some(12), [], [(dt.date(2024, 1, 2), "a", 1, 5)] * 2]):
        for _ in range(2):  # the same load again changes nothing
            before = table._folders(table.version())
            table.merge(spark.createDataFrame(load, fields).repartition(3), ["day", "site", "bucket"])
            gone = {r[:3] for r in load}
            rows = [r for r in rows if r[:3] not in gone] + load
            if rows:
                assert sorted(map(tuple, table.read().collect()), key=str) == sorted(rows, key=str)
            if partition and step == 4:
                after = table._folders(table.version())
                untouched |= {p for p in before if before[p] == after.get(p)}
    assert not partition or len(untouched) >= 4


def test_a_merge_stopped_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    table = PublishedTable(spark, str(tmp_path / "t"), "day")
    load = spark.createDataFrame([(1, "a", 1), (2, "a", 2)], "day int, k string, n int")
    table.merge(load, ["day", "k"])
    writes = []

    def stop(df, write=PublishedTable._write):
        writes.append(1)
        if len(writes) == 2:  # the new rows are written, those to keep are not
            raise OSError("stopped")
        return write(table, df)

    monkeypatch.setattr(table, "_write", stop)
    with pytest.raises(OSError):
        table.merge(spark.createDataFrame([(2, "b", 3)], load.schema), ["day", "k"])
    monkeypatch.undo()
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 1), (2, "a", 2)]
    table.merge(spark.createDataFrame([(2, "b", 3), (2, "a", 9)], load.schema), ["day", "k"])
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 1), (2, "a", 9), (2, "b", 3)]


def test_uniqueness_with_colliding_hashes(spark):
    rows = [("x" * 50 + str(i % 40), i % 3) for i in range(100)] + [(None, 1), (None, 1), ("once", None)]
    df = spark.createDataFrame(rows, "a string, b int")
    want = sorted((str(k), rows.count(k)) for k in set(rows) if rows.count(k) > 1)
    for hashed in (None, F.lit(7).cast("long"), F.pmod(F.hash("a"), F.lit(3)).cast("long")):
        got = sorted((str((r.a, r.b)), r.n) for r in Q.unique_violations(df, ["a", "b"], hashed).collect())
        assert got == want and want
    assert Q.unique_violations(df.limit(0), ["a", "b"]).count() == 0
