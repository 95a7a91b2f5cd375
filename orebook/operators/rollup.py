"""Aggregations: grain roll-ups, ordered strings, JSON lists, fixed pivots, margins, slots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebook.operators.joins import keep_top
from orebook.operators.running import LARGE_ROWS, positions


def grain_rollup(df: DataFrame, keys: Sequence[str], first: Sequence[str] = (), last: Sequence[str] = (),
                 sums: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """One row per grain: ``min`` of attributes and dates, ``max`` of repeated quantities, ``sum`` of flows."""
    return df.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in first], *[F.max(c).alias(c) for c in last],
        *[F.sum(c).alias(c) for c in sums], *extra,
    )


def ordered_text(value: str, order: Sequence[str], sep: str) -> Column:
    """Texts of a group joined in order; nulls are skipped. The text of a group is the result itself."""
    keys = ", ".join(f"`{o}` ASC NULLS LAST" for o in order)
    return F.expr(f"listagg(`{value}`, '{sep}') WITHIN GROUP (ORDER BY {keys})")


def distinct_text(df: DataFrame, keys: Sequence[str], value: str, sep: str, name: str) -> DataFrame:
    """Distinct texts of a group, sorted; duplicates go before the shuffle that gathers the group."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(ordered_text(value, [value], sep).alias(name))


def json_list(sort: Sequence[Column], fields: Sequence[Column]) -> Column:
    """A group as an ordered array of structs; ``sort`` columns lead and are dropped afterwards."""
    item = F.struct(F.struct(*sort).alias("k"), F.struct(*fields).alias("v"))
    return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"])


def list_segments(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunks: Sequence[Column], fields: Sequence[Column],
                  size: int, large_rows: int = LARGE_ROWS) -> DataFrame:
    """Ordered lists of any length: ``keys``, ``segment`` (from 0), ``n`` and ``items``, at most ``size`` structs of ``fields``.

    The place of a row in its group is a running count, which cuts large groups along ``order`` (see
    :func:`orebook.operators.running.running_totals` for ``chunks``). So a group with a third of all rows becomes many
    rows of bounded size, gathered by many tasks; a reader or a sink puts the segments of a group in line.
    """
    placed = positions(df, keys, order, chunks, "__place", large_rows)
    item = F.struct(F.col("__place"), F.struct(*fields).alias("v"))
    out = placed.groupBy(*keys, F.floor((F.col("__place") - 1) / size).cast("long").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
    return out.withColumn("items", F.transform("items", lambda x: x["v"]))


def distinct_flags(df: DataFrame, keys: Sequence[str], item: str, kinds: dict[str, Column]) -> DataFrame:
    """One row per ``keys`` and ``item`` that tells for each kind whether any row is of it; null items are left out.

    Distinct items of any grain coarser than ``keys`` follow from these rows by :func:`count_flags`.
    """
    return df.filter(F.col(item).isNotNull()).groupBy(*keys, item).agg(
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in kinds.items()])


def count_flags(flags: DataFrame, keys: Sequence[str], item: str, total: str, kinds: Sequence[str]) -> DataFrame:
    """Distinct items per ``keys``, in all (``total``) and by kind: flags are merged by item, then counted.

    Conditional distinct counts without a copy of each row per count.
    """
    merged = flags.groupBy(*keys, item).agg(*[F.bool_or(n).alias(n) for n in kinds])
    return merged.groupBy(*keys).agg(F.count(item).alias(total), *[F.count_if(F.col(n)).alias(n) for n in kinds])


def count_distinct_by(df: DataFrame, keys: Sequence[str], item: str, total: str, kinds: dict[str, Column]) -> DataFrame:
    """Conditional distinct counts per ``keys``; a key whose items are all null counts 0."""
    flagged = df.groupBy(*keys, item).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in kinds.items()])
    return flagged.groupBy(*keys).agg(
        F.count(item).alias(total), *[F.count_if(F.col(n) & F.col(item).isNotNull()).alias(n) for n in kinds])


def distinct_bitmaps(df: DataFrame, keys: Sequence[str], number: str, kinds: dict[str, Column]) -> DataFrame:
    """Bitmaps of the whole numbers (0 and up) in ``number`` that occur by kind, 32,768 numbers a row and ``bucket``.

    For dense numbers and coarse keys, where one row per item would be many more.
    """
    x = F.col(number)
    # A bucket begins at 1; the number after is taken, so that 0 has a place.
    return df.filter(x.isNotNull()).groupBy(*keys, F.bitmap_bucket_number(x + 1).alias("bucket")).agg(
        *[F.bitmap_construct_agg(F.bitmap_bit_position(F.when(c, x + 1))).alias(n) for n, c in kinds.items()])


def count_bitmaps(bitmaps: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Distinct numbers per ``keys``, a grain no finer than that of the bitmaps."""
    merged = bitmaps.groupBy(*keys, "bucket").agg(*[F.bitmap_or_agg(n).alias(n) for n in kinds])
    return merged.groupBy(*keys).agg(*[F.sum(F.bitmap_count(n)).alias(n) for n in kinds])


def null_last_key(c: Column) -> list[Column]:
    """Sort fields that put null last inside a struct."""
    return [c.isNull().alias("n"), c.alias("x")]


def pivot_fixed(df: DataFrame, keys: Sequence[str], column: str, values: dict[str, str], measure: Column,
                fill=0) -> DataFrame:
    """One column per known value (value to column name), summed by condition in one pass."""
    sums = [F.coalesce(F.sum(F.when(F.col(column) == v, measure)), F.lit(fill)).alias(n) for v, n in values.items()]
    return df.groupBy(*keys).agg(*sums)


def pivot_margins(df: DataFrame, row: str, column: str, values: Sequence[str], measure: Column) -> DataFrame:
    """Row by column sums with a Total row and a Total column; columns in the given order."""
    sums = [F.coalesce(F.sum(F.when(F.col(column) == v, measure)), F.lit(0)).alias(v) for v in values]
    known = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    out = known.rollup(row).agg(*sums, F.coalesce(F.sum(measure), F.lit(0)).alias("Total"),
                                F.grouping(row).alias("__all"))
    return out.withColumn(row, F.when(F.col("__all") == 1, F.lit("Total")).otherwise(F.col(row))).drop("__all")


def slots(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of a key side by side: ``<column>_1`` to ``<column>_n``."""
    top = keep_top(df, keys, order, n, rank="__slot")
    return top.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__slot") == i, F.col(c))).alias(f"{c}_{i}") for i in range(1, n + 1) for c in columns]
    )


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, missing columns as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def melt_pairs(df: DataFrame, ids: Sequence[str], first: dict[int, str], second: dict[int, str],
               first_name: str, second_name: str, number: str = "month") -> DataFrame:
    """Two blocks of period columns to one row per period with both measures, in one scan."""
    periods = F.array(*[
        F.struct(F.lit(p).alias(number), F.col(f"`{first[p]}`").alias(first_name),
                 F.col(f"`{second[p]}`").alias(second_name))
        for p in first
    ])
    return df.select(*ids, F.inline(periods))
