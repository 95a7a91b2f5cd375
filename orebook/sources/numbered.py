"""Text files by line number: title rows skipped by count, files of many header forms in one scan.

Spark splits a file and reads the splits apart, so a line does not know its number. Counted are the lines of each split;
the running sum of these counts, one row per split, gives the number of a split's first line, and a line's place in
its split is known to the task that reads it. No file is bound to one task.

Headers are one line per file. Their distinct forms are read by the driver, which turns each into the places of the
wanted columns; lines meet the places of their file in a join, so the plan is the same for one file or thousands.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebook.functions.clean import NA_TEXTS, headers_strict, na_to_null
from orebook.sources.csv_files import FILE, _require
from orebook.sources.tables import reference_table

BOM = "﻿"


def numbered_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """``__file``, ``number`` (from 0) and ``line`` of every line, blank ones too; a byte-order mark is taken off."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    _require(spark, paths)
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("__at"),
        F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line"))
    if encoding.upper() not in ("UTF-8", "UTF8"):
        lines = lines.withColumn("line", F.decode(F.col("line").cast("binary"), encoding))
    splits = lines.groupBy(FILE, "__at").agg(F.min("__id").alias("__first"), F.count("__id").alias("__n"))
    before = Window.partitionBy(FILE).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(FILE, "__at", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    number = F.col("__id") + F.col("__shift")
    line = F.when(number == 0, F.ltrim(F.col("line"), F.lit(BOM))).otherwise(F.col("line"))
    return lines.join(splits, [FILE, "__at"]).select(FILE, number.alias("number"), F.rtrim(line, F.lit("\r")).alias("line"))


def _parsed(lines: DataFrame, width: int, sep: str) -> Column:
    fields = ", ".join(f"c{i} string" for i in range(width))
    row = F.from_csv(F.col("line"), fields, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return F.array(*[row[f"c{i}"] for i in range(width)])


def by_header(lines: DataFrame, skip: int, columns: Sequence[str], place: Callable[[list[str]], list[int]], sep: str = ",",
              na: Sequence[str] = NA_TEXTS) -> DataFrame:
    """``columns`` and ``__file`` of the lines below the header, which is the line after ``skip`` others.

    ``place`` tells from the names of a header where the columns stand, -1 for one that is missing (null). Blank lines are
    no rows.
    """
    spark = lines.sparkSession
    heads = lines.filter(F.col("number") == skip).select(FILE, F.col("line").alias("__head"))
    forms = sorted(r["__head"] for r in heads.select("__head").distinct().collect())  # one row per form of header
    names = {h: next(csv.reader([h], delimiter=sep), []) for h in forms}
    places = reference_table(spark, [(h, place(n)) for h, n in names.items()], "__head string, __places array<int>")
    width = max([1, *map(len, names.values())])
    rows = (lines.filter((F.col("number") > skip) & (F.col("line") != "")).join(heads.join(places, "__head").drop("__head"), FILE)
            .withColumn("__row", _parsed(lines, width, sep)))
    return rows.select(*[na_to_null(F.get("__row", F.get("__places", F.lit(i))), na).alias(c) for i, c in enumerate(columns)], FILE)


def read_csv_skipping(spark: SparkSession, paths: str | Sequence[str], skip: int, columns: Sequence[str], encoding: str = "UTF-8",
                      sep: str = ",", na: Sequence[str] = NA_TEXTS, with_file: bool = False) -> DataFrame:
    """CSV files with ``skip`` title rows above the header, columns by name whatever their order; a header without one of
    them is an error. Fields do not span lines; a file of ``skip`` lines or fewer has no rows."""
    def place(names: list[str]) -> list[int]:
        at = [n.strip() for n in names]
        if missing := [c for c in columns if c.strip() not in at]:
            raise ValueError(f"columns {missing} are not in the header {names}")
        return [at.index(c.strip()) for c in columns]

    out = by_header(numbered_lines(spark, paths, encoding), skip, [c.strip() for c in columns], place, sep, na)
    return out.withColumnRenamed(FILE, "file_path") if with_file else out.drop(FILE)


def read_snapshots(spark: SparkSession, paths: str | Sequence[str], reference: Sequence[str], tab: Callable[[Column], Column],
                   skip: int = 0, fmt: str = "MM.dd.yy", encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """Snapshots of one report, any number of files, in the columns of ``reference``, with tab name and date.

    ``tab`` takes the name of the snapshot from the file's path. A blank header takes the reference's name at its place,
    stray columns go, missing ones are null; a name that is no date gives a null date.
    """
    wanted = headers_strict(list(reference))

    def place(names: list[str]) -> list[int]:
        strict = [wanted[i] if n.startswith("col_") and i < len(wanted) else n for i, n in enumerate(headers_strict(names))]
        return [strict.index(c) if c in strict else -1 for c in wanted]

    rows = by_header(numbered_lines(spark, paths, encoding), skip, wanted, place, sep)
    rows = rows.withColumn("source_tab", tab(F.col(FILE)))
    day = F.try_to_timestamp(F.trim("source_tab"), F.lit(fmt)).cast("date")
    # Two-digit years from 69 on belong to the last century.
    return rows.withColumn("snapshot_date", F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)).drop(FILE)
