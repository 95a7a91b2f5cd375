"""Delimited files: all-text reads, missing-value texts, history stacks, file-name fields, snapshots."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebook.functions.clean import NA_TEXTS, header_simple, headers_strict, na_to_null
from orebook.operators.rollup import stack


FILE = "__file"


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _require(spark: SparkSession, paths: Sequence[str]) -> None:
    """Fail early when a path or glob matches no file."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).globStatus(path)
        if found is None or len(found) == 0:
            raise FileNotFoundError(f"no file matches {p}")


def read_text_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None,
                  encoding: str = "UTF-8", header: bool = True, with_file: bool = False,
                  sep: str = ",", na: Sequence[str] = NA_TEXTS, multi_line: bool = False) -> DataFrame:
    """CSV files as text columns with missing-value texts as null and header names trimmed.

    A quote inside a quoted field is doubled; ``multi_line`` lets such fields span lines, at the
    price of files that do not split. ``columns`` gives the columns wanted: of files with a header
    they are found by name, whatever their order, and files of different headers may be read
    together (a column that none of them has is an error); of files without one they are taken by
    position. ``with_file`` adds ``file_path``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    _require(spark, paths)
    reader = (spark.read.option("header", header).option("encoding", encoding).option("sep", sep)
              .option("quote", '"').option("escape", '"').option("multiLine", multi_line))
    if columns is None:
        df = reader.csv(paths)
    elif not header:
        df = reader.schema(text_schema(columns)).csv(paths)
    else:
        df = _by_header(spark, reader, paths, columns, encoding, sep)
    names = [c for c in df.columns if c != FILE]
    path = F.col(FILE) if FILE in df.columns else F.col("_metadata.file_path")
    return df.select(
        *[na_to_null(F.col(f"`{c}`"), na).alias(c.strip()) for c in names], *([path.alias("file_path")] if with_file else [])
    )


def _by_header(spark: SparkSession, reader, paths: Sequence[str], columns: Sequence[str], encoding: str, sep: str) -> DataFrame:
    """The wanted columns of files grouped by their header line; finding the headers costs one scan for the first lines."""
    lines = spark.read.option("encoding", encoding).option("header", False).option("sep", "\x01").option("quote", "").schema("line string").csv(list(paths))
    heads = (lines.select("line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
             .where("at = 0").withColumn("n", F.monotonically_increasing_id())
             .groupBy("file").agg(F.min_by("line", "n").alias("head")).groupBy("head").agg(F.collect_list("file").alias("files")))
    frames = []
    for row in sorted(heads.collect()):  # one row per form of header, with the names of its files
        names = next(csv.reader([row["head"].lstrip("\ufeff")], delimiter=sep))
        at = {n.strip(): n for n in names}
        if missing := [c for c in columns if c.strip() not in at]:
            raise ValueError(f"columns {missing} are not in the header {row['head']!r}")
        df = reader.schema(text_schema([f"{n}" if names.count(n) == 1 else f"{n}.{i}" for i, n in enumerate(names)])).option("enforceSchema", True).csv(row["files"])
        frames.append(df.select(*[F.col(f"`{at[c.strip()]}`").alias(c) for c in columns], F.col("_metadata.file_path").alias(FILE)))
    none = spark.createDataFrame([], text_schema([*columns, FILE]))
    return reduce(DataFrame.unionAll, frames) if frames else none


def read_text_csv_below(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], data_row: Column,
                        encoding: str = "UTF-8", na: Sequence[str] = NA_TEXTS) -> DataFrame:
    """CSV files with title rows above the header, columns by position.

    Spark cannot skip a number of rows, and counting them would bind a file to one task;
    ``data_row`` tells data from titles row by row, so large files still split.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    _require(spark, paths)
    df = spark.read.schema(text_schema(columns)).option("encoding", encoding).option("escape", '"').csv(paths)
    return df.filter(data_row).select(*[na_to_null(F.col(f"`{c}`"), na).alias(c) for c in columns])


def with_history(current: DataFrame, history: Sequence[DataFrame]) -> DataFrame:
    """Closed-year files and the year-to-date file as one table."""
    return stack([*history, current])


def rename_simple(df: DataFrame) -> DataFrame:
    return df.toDF(*[header_simple(c) for c in df.columns])


def rename_strict(df: DataFrame) -> DataFrame:
    return df.toDF(*headers_strict(df.columns))


def rename_by_map(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The listed columns under their new names, in the map's order."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def site_from_file(file_path: Column, pattern: str = r"Inventory_([A-Za-z0-9]+)\.txt") -> Column:
    return F.nullif(F.regexp_extract(file_path, pattern, 1), F.lit(""))


def period_from_file(file_path: Column, pattern: str = r"_(\d{2})-(\d{4})\.csv") -> list[Column]:
    """Month and year of ``…_MM-YYYY.csv``; null when the name has none."""
    return [F.regexp_extract(file_path, pattern, g).try_cast("int").alias(n) for g, n in ((1, "month"), (2, "year"))]


def conform_snapshots(snapshots: Sequence[tuple[str, DataFrame]], fmt: str = "MM.dd.yy") -> DataFrame:
    """Snapshots of one report in the columns of the first, tagged with tab name and date.

    Blank headers take the first snapshot's name at their position, stray columns go, missing
    ones are null; a name that is no date gives a null date.
    """
    reference = headers_strict(snapshots[0][1].columns)
    frames = []
    for name, df in snapshots:
        names = [
            reference[i] if n.startswith("col_") and i < len(reference) else n
            for i, n in enumerate(headers_strict(df.columns))
        ]
        df = df.toDF(*names)
        kept = [F.col(c).cast("string").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in reference]
        tab = F.lit(name)
        day = F.try_to_timestamp(F.trim(tab), F.lit(fmt)).cast("date")
        # Two-digit years from 69 on belong to the last century.
        day = F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)
        frames.append(df.select(*kept, tab.alias("source_tab"), day.alias("snapshot_date")))
    return stack(frames)


def read_seed(spark: SparkSession, path: str, schema: str, date_format: str = "M/d/yyyy") -> DataFrame:
    """A typed reference table; a byte-order mark before the header is ignored."""
    return spark.read.schema(schema).option("header", True).option("dateFormat", date_format).option("escape", '"').csv(path)


def site_of_files(rows: DataFrame, file: str, row_no: str, field: str, cities: DataFrame) -> DataFrame:
    """Site of each file: the first row whose field names a known city, in any case.

    ``cities`` has (city, site).
    """
    known = cities.select(F.lower("city").alias("__city"), F.col("site"))
    hits = rows.select(F.col(file), F.col(row_no), F.lower(F.trim(field)).alias("__city")).join(known, "__city")
    return hits.groupBy(file).agg(F.min_by("site", F.struct(row_no, "site")).alias("site"))
