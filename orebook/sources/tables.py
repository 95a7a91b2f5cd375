"""Tables: parquet and SQL endpoints, pruned and partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebook.session import size_for, stored_bytes


class Tables:
    """The given tables of one folder, read lazily: ``t.orders`` or ``t["orders"]``.

    A table larger than the session's shuffle partitions can hold raises their number before it is used.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        size_for(self.spark, stored_bytes(table))
        return table

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]


def reference_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table from literal rows. Built from an Arrow table, it is part of the plan with its
    exact size, which is what lets Spark decide to broadcast it; rows given one by one have no
    known size and would be joined by a shuffle of the other side."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table)


def pruned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """An extract of named columns; the scan reads only these."""
    return df.select(*columns)


def jdbc_options(url: str, query_or_table: str, partition_column: str | None = None,
                 bounds: tuple[str, str] | None = None, partitions: int | None = None,
                 fetch_size: int = 10_000) -> dict[str, str]:
    """Options of a partitioned read from a SQL endpoint; a query is wrapped as a derived table
    because Spark does not combine ``query`` with partitioning."""
    table = f"({query_or_table}) src" if query_or_table.lstrip().lower().startswith(("select", "with")) else query_or_table
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_column and bounds and partitions:
        options |= {"partitionColumn": partition_column, "lowerBound": bounds[0], "upperBound": bounds[1],
                    "numPartitions": str(partitions)}
    return options


def read_jdbc(spark: SparkSession, url: str, query_or_table: str, **kw) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, query_or_table, **kw)).load()


def left_dimension(facts: DataFrame, dim: DataFrame, on: tuple[str, str], columns: Sequence[str]) -> DataFrame:
    """A fact extract with the named columns of a dimension, both sides pruned before the join."""
    right = dim.select(F.col(on[1]).alias("__key"), *[c for c in columns if c != on[1]])
    return facts.join(right, facts[on[0]] == right["__key"], "left").drop("__key")
