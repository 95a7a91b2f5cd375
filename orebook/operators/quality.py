"""Data quality: violations as DataFrames, schema contracts, safe integers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the largest integer a double holds exactly.
SAFE_INT = 2**53


def not_null_violations(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique_violations(df: DataFrame, keys: Sequence[str], hashed: Column | None = None) -> DataFrame:
    """Keys held by more than one row.

    Rows are counted by a 64-bit hash of the key first, which shuffles eight bytes a row whatever the keys are; only rows
    whose hash is not unique are then counted by the keys themselves, so that two keys of one hash are told apart.
    """
    named = df.select(*keys, (F.xxhash64(*keys) if hashed is None else hashed).alias("__hash"))
    shared = named.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__hash")
    return named.join(shared, "__hash", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def schema_contract(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """``df`` if its columns are the expected ones in order; an error otherwise."""
    if list(expected) != df.columns:
        raise ValueError(f"columns differ: expected {list(expected)}, found {df.columns}")
    return df


def integer_text_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per text column: whether its digit texts may all become integers.

    They may when every one reads back as the same text and none is beyond the exact range
    of a double. One pass over the data.
    """
    aggs = []
    for c in columns:
        digits = F.col(c).rlike(r"^-?\d+$")
        value = F.when(digits, F.col(c)).try_cast("bigint")
        fine = (value.cast("string") == F.col(c)) & (F.abs(value) <= SAFE_INT)
        aggs += [F.count(F.when(digits, 1)).alias(f"{c}__n"),
                 F.coalesce(F.bool_and(F.when(digits, F.coalesce(fine, F.lit(False)))), F.lit(False)).alias(f"{c}__ok"),
                 F.coalesce(F.bool_and(digits), F.lit(False)).alias(f"{c}__all")]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("digit_texts"), F.col(f"{c}__ok").alias("convertible"),
                 F.col(f"{c}__all").alias("only_digits"))
        for c in columns
    ])))


def convert_integer_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns found safe by :func:`integer_text_columns` become integers; a column that also holds
    other texts stays text, as a Spark column has one type.

    Only the verdict, one row per column, reaches the driver.
    """
    verdict = integer_text_columns(df, columns).filter("convertible and only_digits")
    safe = {r["column_name"] for r in verdict.collect()}
    return df.withColumns({c: F.col(c).try_cast("bigint") for c in columns if c in safe})
