"""Writers: load modes with added columns, materialisation, snapshot logs, report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebook.session import shared_path
from orebook.sources.csv_files import text_schema

BOM = "﻿"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def load(df: DataFrame, path: str, mode: str = "truncate") -> None:
    """Write a table folder. ``replace``: new schema; ``append``: add rows; ``truncate``: new rows
    in the old columns plus the new ones as text.

    New columns of an append are in the new files only, so the folder is read by :func:`read_loaded`.
    """
    spark = df.sparkSession
    if mode not in ("replace", "truncate", "append"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "replace" or not _exists(spark, path):
        df.write.mode("overwrite").parquet(path)
        return
    old = read_loaded(spark, path).schema
    known = {f.name: f.dataType for f in old.fields}
    cols = [F.col(f"`{n}`").cast(t).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in known.items()]
    cols += [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c not in known]
    df.select(*cols).write.mode("overwrite" if mode == "truncate" else "append").parquet(path)


def read_loaded(spark: SparkSession, path: str) -> DataFrame:
    """A table folder with the columns of all its files; null where a file lacks one."""
    return spark.read.option("mergeSchema", True).parquet(path)


def materialise(df: DataFrame, name: str, kind: str, path: str | None = None) -> DataFrame:
    """A model as a view, or as a table folder written once and read back."""
    if kind == "view":
        df.createOrReplaceTempView(name)
        return df.sparkSession.table(name)
    if kind != "table":
        raise ValueError(f"unknown kind {kind}")
    path = path or shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.createOrReplaceTempView(name)
    return out


def not_logged(snapshot: DataFrame, log: DataFrame, date: str) -> DataFrame:
    """Snapshot rows of days the log does not hold."""
    return snapshot.join(log.select(date).distinct(), date, "left_anti")


def log_snapshot(snapshot: DataFrame, path: str, date: str = "snapshot_date") -> None:
    """Add a day to a log partitioned by date; a day already logged stays as it is.

    Only the partitions of new days are written, so a repeated or failed run leaves no
    second copy.
    """
    spark = snapshot.sparkSession
    if _exists(spark, path):
        snapshot = not_logged(snapshot, spark.read.parquet(path), date)
    snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def csv_with_bom(df: DataFrame, path: str, where: Column | None = None, archive: str | None = None,
                 single_file: bool = False) -> None:
    """CSV with a byte-order mark before the header, and a dated copy of what was written.

    ``single_file`` is for extracts known to be small; the default keeps one file per task, each
    with its own mark and header.
    """
    out = df if where is None else df.filter(where)
    first = out.columns[0]
    out = out.withColumnRenamed(first, BOM + first)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    if archive:
        written = out.sparkSession.read.schema(text_schema(out.columns)).option("header", True).option("escape", '"').csv(path)
        written.write.mode("overwrite").option("header", True).option("escape", '"').csv(archive)


def sorted_extract(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Rows in report order; ``(column, ascending)`` pairs, nulls last either way."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys])


def per_site_files(df: DataFrame, site: str, path: str, master: str | None = None) -> None:
    """One folder per site, and one master folder; a busy site is written by many tasks."""
    df.write.mode("overwrite").partitionBy(site).parquet(path)
    if master:
        written = df.sparkSession.read.schema(df.schema).parquet(path)
        written.select(*df.columns).write.mode("overwrite").parquet(master)
