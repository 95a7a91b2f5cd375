"""Files in and out, JSON payloads, cleaning, the stream of machine events."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from orebook.functions import clean as C
from orebook.functions import text as X
from orebook.operators import hours as H
from orebook.sinks import writers as W
from orebook.sources import csv_files as S
from orebook.sources import feeds as FD
from orebook.sources import tables as T
from orebook.streaming import machine_stream as MS


def test_csv_missing_texts_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id , name\n1,Undefined\n2,#DIV/0!\n3,Andr\xe9\n4,NaN\n".encode("latin-1"))
    out = S.read_text_csv(spark, str(tmp_path / "*.csv"), encoding="ISO-8859-1").orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in out] == [("1", None), ("2", None), ("3", "André"), ("4", None)]
    with pytest.raises(FileNotFoundError):
        S.read_text_csv(spark, str(tmp_path / "none*.csv"))


def test_title_rows_are_left_out(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Report,,\nprinted,,\nNumber,Name,Jan\n1,Ann,5\n2,Bo,N/A\n")
    out = S.read_text_csv_below(spark, str(tmp_path / "w.csv"), ["number", "name", "jan"], F.col("number").try_cast("double").isNotNull())
    assert sorted(tuple(r) for r in out.collect()) == [("1", "Ann", "5"), ("2", "Bo", None)]


def test_site_and_period_of_files(spark, tmp_path):
    (tmp_path / "Inventory_ATX.txt").write_text("l1,5\n")
    (tmp_path / "us_hours_03-2026.csv").write_text("a\n1\n")
    inv = S.read_text_csv(spark, str(tmp_path / "Inventory_*.txt"), columns=["lot", "q"], header=False, with_file=True)
    assert inv.select(S.site_from_file(F.col("file_path")).alias("s")).first()["s"] == "ATX"
    hrs = S.read_text_csv(spark, str(tmp_path / "us_*.csv"), columns=["a"], with_file=True)
    assert tuple(hrs.select(*S.period_from_file(F.col("file_path"))).first()) == (3, 2026)


def test_headers():
    assert C.headers_strict([" Order\xa0Line", "Total (US$)", "  ", "A--B"]) == ["order_line", "total_us", "col_2", "a_b"]
    assert C.header_simple(" Margin % ") == "Margin_pct"


def test_rates_and_devices(spark):
    text = '{"base":"USD","rates":{"2024-01-02":{"EUR":0.9,"MXN":17.0,"GBP":0,"JPY":null}}}'
    out = FD.rates_long(spark.createDataFrame([(text,)], "payload string")).collect()
    assert sorted((r["from_currency"], r["rate"]) for r in out) == [("EUR", 1.11111111), ("MXN", 0.05882353)]
    good = '{"columns":[{"name":"id"},{"name":"v"}],"records":[["1","a"],["2",null]]}'
    df = spark.createDataFrame([("d1", good), ("d2", '{"columns":[{"name":"id"}],"records":[]}'), ("d3", "oops")], "dev string, payload string")
    rows = FD.device_records(df, F.col("dev"), F.concat(F.lit("n"), "dev")).collect()
    assert sorted((r["device_id"], r["record"]["id"]) for r in rows) == [("d1", "1"), ("d1", "2")]


def test_jdbc_read_is_partitioned():
    o = T.jdbc_options("jdbc:x", "select a from b", "a", ("0", "10"), 4)
    assert o["dbtable"] == "(select a from b) src" and o["numPartitions"] == "4"
    assert T.jdbc_options("jdbc:x", "t")["dbtable"] == "t"


def test_key_and_date_texts(spark):
    df = spark.createDataFrame([("7000001-4.1", "18-JUN-26", "1234567.0", " . ", "a.CO"), ("7-1.2", "", "12.05", "3.2", "b.CO.BO")], "k string, d string, j string, ls string, item string")
    o, ln, sh = X.order_key(F.col("k"))
    a, b = X.line_ship(F.col("ls"))
    out = df.select(o.alias("o"), ln.alias("l"), sh.alias("s"), X.two_digit_year_date(F.col("d")).alias("d"), X.strip_point_zero(F.col("j")).alias("j"),
                    a.alias("a"), b.alias("b"), X.strip_component_suffix(F.col("item")).alias("i")).collect()
    assert tuple(out[0]) == ("7000001", "4", "1", dt.date(2026, 6, 18), "1234567", None, None, "a")
    assert tuple(out[1]) == ("7", "1", "2", None, "12.05", "3", "2", "b.CO")
    items = spark.createDataFrame([(x,) for x in ("x_1", "x_1-P.BO", "x-P", "x.CO", "x.MC", "x_10", "x.XP")], "i string")
    assert [r[0] for r in items.select(X.clean_item(F.col("i"))).collect()] == ["x", "x", "x", "x", "x", "x_10", "x.XP"]


def test_spec_modes(spark):
    df = spark.createDataFrame([(" 5 ", " Ab ", "1900-01-01"), ("", "x", "2024-02-03"), (None, "y", None)], "q string, n string, d string")
    specs = [C.ColumnSpec("q", "qty", "decimal(18,2)", blank_null=True), C.ColumnSpec("n", "name", lower=True), C.ColumnSpec("d", "day", "date", no_date=True)]
    out = C.clean(df, specs).collect()
    assert [(r["name"], r["day"]) for r in out] == [("ab", None), ("x", dt.date(2024, 2, 3)), ("y", None)] and out[0]["qty"] == 5 and out[1]["qty"] is None
    assert C.clean(df, specs, ["qty"]).count() == 1
    bad = spark.createDataFrame([("x",)], "q string")
    assert C.clean(bad, [C.ColumnSpec("q", "q", "int", lenient=True)]).first()["q"] is None
    with pytest.raises(Exception):
        C.clean(bad, [C.ColumnSpec("q", "q", "int")]).collect()


def test_load_modes(spark, tmp_path):
    p = str(tmp_path / "t")
    row = lambda n, extra=False: spark.range(n, n + 1).withColumn("x", F.lit(1.5)) if extra else spark.range(n, n + 1)
    W.load(row(1), p, "truncate")
    W.load(row(2, True), p, "truncate")
    W.load(row(3), p, "append")
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [(2, "1.5"), (3, None)]
    W.load(row(4), p, "replace")
    assert spark.read.parquet(p).columns == ["id"]
    with pytest.raises(ValueError):
        W.load(row(4), p, "merge")


def test_snapshot_log_keeps_logged_days(spark, tmp_path):
    p = str(tmp_path / "log")
    snap = lambda d, n: spark.createDataFrame([("a", n, d)], "k string, n int, snapshot_date date")
    W.log_snapshot(snap(dt.date(2024, 1, 1), 1), p)
    W.log_snapshot(snap(dt.date(2024, 1, 1), 9), p)
    W.log_snapshot(snap(dt.date(2024, 1, 2), 2), p)
    assert sorted((r["snapshot_date"].day, r["n"]) for r in spark.read.parquet(p).collect()) == [(1, 1), (2, 2)]


def test_bom_is_the_first_thing_in_the_file(spark, tmp_path):
    p = str(tmp_path / "x")
    W.csv_with_bom(spark.range(3), p, where=F.col("id") > 0, single_file=True)
    (part,) = [f for f in os.listdir(p) if f.startswith("part")]
    assert open(os.path.join(p, part), "rb").read().startswith(b"\xef\xbb\xbfid")
    assert sorted(r["id"] for r in S.read_seed(spark, p, "id int").collect()) == [1, 2]


def test_site_of_files_ignores_case_and_takes_the_first_row(spark):
    rows = spark.createDataFrame([("f", 1, "nowhere"), ("f", 2, " DALLAS "), ("f", 3, "Austin")], "file string, n int, city string")
    cities = spark.createDataFrame([("Dallas", "D"), ("Austin", "A")], "city string, site string")
    assert S.site_of_files(rows, "file", "n", "city", cities).first()["site"] == "D"


def test_machine_stream_equals_batch(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    T0 = dt.datetime(2024, 1, 2, 1)
    rows = [(1, "x", T0, 7200.0), (2, "Detecting State", T0, 60.0), (3, None, T0, 60.0)]
    schema = "id int, state string, e timestamp_ntz, s double"
    spark.createDataFrame(rows, schema).write.parquet(src)
    MS.write_available(MS.split_stream(MS.read_events(spark, src, schema), "state", "e", "s"), out, chk).awaitTermination()
    batch = MS.split_stream(spark.read.parquet(src), "state", "e", "s")
    got = sorted((r["id"], r["event_date"], r["allocated_duration_sec"]) for r in spark.read.parquet(out).collect())
    assert got == sorted((r["id"], r["event_date"], r["allocated_duration_sec"]) for r in batch.collect()) and len(got) == 2


def test_csv_quotes_and_header_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,descr,more\n1,"1/2"" BAR, round",x\n2,plain,y\n')
    (tmp_path / "b.csv").write_text("descr,id\nfoo,3\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    rows = S.read_text_csv(spark, paths, columns=["id", "descr"]).collect()
    assert sorted(tuple(r) for r in rows) == [("1", '1/2" BAR, round'), ("2", "plain"), ("3", "foo")]
    with pytest.raises(ValueError, match="more"):
        S.read_text_csv(spark, paths, columns=["id", "more"])


def test_two_appends_keep_new_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    W.load(spark.createDataFrame([(1,)], "a int"), path, "replace")
    W.load(spark.createDataFrame([(2, "x")], "a int, extra string"), path, "append")
    W.load(spark.createDataFrame([(3, "y", "z")], "a int, extra string, more string"), path, "append")
    assert sorted((tuple(r) for r in W.read_loaded(spark, path).collect()), key=str) == [(1, None, None), (2, "x", None), (3, "y", "z")]


def test_short_and_long_device_records(spark):
    text = '{"device": "d", "columns": [{"name": "a"}, {"name": "b"}], "records": [["1", "2"], ["3"], ["4", "5", "6"]]}'
    df = spark.createDataFrame([("d", text), ("e", '{"columns": [')], "id string, payload string")
    good = FD.device_records(df, F.col("id"), F.col("id")).collect()
    assert sorted((r["record"]["a"], r["record"]["b"]) for r in good if r["record"]["b"]) == [("1", "2")]
    assert [r["record"] for r in good if r["record"]["a"] == "3"] == [{"a": "3", "b": None}]
    bad = FD.unfit_records(df, F.col("id"), F.col("id")).collect()
    assert sorted((r.device_id, r.reason) for r in bad) == [("d", "more values than columns"), ("e", "payload does not parse")]


def test_wide_feed_told_by_department_text(spark):
    raw = spark.createDataFrame(
        [("7.0", "Ann", "Plant - Processing", "S1"), ("8.0", "Bob", "Office", "S2")], "number string, name string, dept string, place string")
    raw = raw.select("*", *[F.lit(str(n)).alias(m) for n, m in enumerate(H.MONTHS, 1)], *[F.lit("1").alias(f"{m}.1") for m in H.MONTHS])
    ids = {"number": "employee_id", "name": "employee_name", "dept": "dept_code"}
    out = H.wide_feed(raw, ids, 2025, "CN", F.col("place").alias("site"), department="Plant - Processing").collect()
    assert len(out) == 12 and {(r.site, r.dept_code, r.employee_id) for r in out} == {("S1", H.WIDE_DEPT, "7")}
    assert sorted(float(r.total_hrs) for r in out) == [float(n + 1) for n in range(1, 13)]
