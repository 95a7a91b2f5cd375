"""Yield metrics on the two bases, the final union and its report grains."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebook.functions.dates import trailing_flags
from orebook.functions.numbers import ratio, unit_cost_value
from orebook.operators.rollup import ordered_text, stack

MEASURES = (
    "picked_lbs", "picked_usd", "complete_lbs", "complete_usd", "engineered_lbs", "engineered_usd",
    "yieldloss_lbs", "yieldloss_usd", "yieldvar_lbs", "yieldvar_usd",
)


def _losses(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "yieldloss_lbs": c("picked_lbs") - c("complete_lbs"), "yieldloss_usd": c("picked_usd") - c("complete_usd"),
        "yieldvar_lbs": c("picked_lbs") - c("engineered_lbs"), "yieldvar_usd": c("picked_usd") - c("engineered_usd"),
    })


def yield_output_basis(df: DataFrame) -> DataFrame:
    """From picked, complete and engineered pounds and picked value: values at the issued unit
    cost, losses, and the three yields."""
    c = F.col
    out = _losses(df.withColumns({
        "complete_usd": unit_cost_value(c("picked_usd"), c("picked_lbs"), c("complete_lbs")),
        "engineered_usd": unit_cost_value(c("picked_usd"), c("picked_lbs"), c("engineered_lbs")),
    }))
    engineered, actual = ratio(c("complete_lbs"), c("engineered_lbs")), ratio(c("complete_lbs"), c("picked_lbs"))
    return out.withColumns({
        "engineered_yield": engineered, "actual_yield": actual, "yield_performance": ratio(actual, engineered),
    })


def order_item_facts(rows: DataFrame, order: str, item: str, lbs: Column, usd: Column, num: Column, den: Column,
                     picked: Column, by_item: Column, by_order: Column, made: Column, rate: str,
                     sums: dict[str, Column] | None = None, greatest: dict[str, Column] | None = None) -> DataFrame:
    """One conditional aggregate by (order, item) that feeds both bases.

    ``picked``, ``by_item``, ``by_order`` and ``made`` tell what a row counts for: picked material, the item's and the
    order's bill of material (``num`` / ``den``, ratio of maxima and of sums), output. ``rate`` is the type of a yield;
    ``sums`` and ``greatest`` are further measures, summed and maximised. Rows without an order are left out.
    """
    item_yield = ratio(F.max(F.when(by_item, num)), F.max(F.when(by_item, den)))
    return rows.filter(F.col(order).isNotNull()).groupBy(order, item).agg(
        F.coalesce(F.bool_or(picked), F.lit(False)).alias("__picked"),
        F.sum(F.when(picked, lbs)).alias("picked_lbs"), F.sum(F.when(picked, usd)).alias("picked_usd"),
        F.when(F.col(item).isNotNull(), item_yield).cast(rate).alias("item_yield"),
        F.sum(F.when(by_order, num)).alias("__num"), F.sum(F.when(by_order, den)).alias("__den"),
        F.sum(F.when(made, lbs)).alias("complete_lbs"),
        *[F.sum(c).alias(n) for n, c in (sums or {}).items()], *[F.max(c).alias(n) for n, c in (greatest or {}).items()],
    )


def order_facts(facts: DataFrame, order: str, item: str, rate: str, money: str, sums: Sequence[str] = (),
                greatest: Sequence[str] = ()) -> DataFrame:
    """One aggregate by order of :func:`order_item_facts`: picked amounts and items, output, ``engineered_yield``.

    Expected pounds are those picked times the item's yield, else the order's, else 1. The order's yield is known only
    after the aggregate, so the pounds of items without a yield of their own are summed apart.
    """
    text = facts.withColumn("__text", F.when(F.col("__picked"), F.col(item).cast("string")))
    lbs = F.col("picked_lbs")
    out = text.groupBy(order).agg(
        F.bool_or("__picked").alias("any_picked"), ordered_text("__text", ["__text"], ", ").alias("picked_items"),
        F.sum(lbs).cast(money).alias("picked_lbs"), F.sum("picked_usd").cast(money).alias("picked_usd"),
        F.sum(lbs * F.col("item_yield")).alias("__known"), F.sum(F.when(F.col("item_yield").isNull(), lbs)).alias("__rest"),
        ratio(F.sum("__num"), F.sum("__den")).cast(rate).alias("__order_yield"),
        F.sum("complete_lbs").cast(money).alias("complete_lbs"),
        *[F.sum(n).cast(money).alias(n) for n in sums], *[F.max(n).alias(n) for n in greatest],
    )
    zero, one = F.lit(0), F.lit(1)
    expected = F.coalesce("__known", zero) + F.coalesce("__rest", zero) * F.coalesce("__order_yield", one)
    return out.withColumn("engineered_yield", ratio(expected.cast(money), F.col("picked_lbs"))).drop("__known", "__rest", "__order_yield")


def yield_bom_basis(orders: DataFrame) -> DataFrame:
    """From picked amounts, output and the expected yield of an order: its values, losses and yields."""
    c = F.col
    unit_cost = ratio(c("picked_usd"), c("picked_lbs"))
    out = _losses(orders.withColumns({
        "complete_usd": c("complete_lbs") * unit_cost,
        "engineered_lbs": ratio(c("complete_lbs"), c("engineered_yield")),
        "engineered_usd": ratio(c("complete_lbs"), c("engineered_yield")) * unit_cost,
    }))
    actual = ratio(c("complete_lbs"), c("picked_lbs"))
    return out.withColumns({"actual_yield": actual, "yield_performance": ratio(actual, c("engineered_yield"))})


def yield_final(bases: Sequence[DataFrame], since: dt.date, as_of: dt.date, status: str, done: Sequence[str],
                complete_date: str, excluded_op: str, loss_op: str, calendar: DataFrame,
                missing_lbs: float = -99999) -> DataFrame:
    """Finished jobs with something picked, of both bases, with their fiscal period.

    A null loss operation or null output fails its test, as in SQL. The filter stands before
    the union so that it reaches each base's scan.
    """
    kept = [
        b.filter(
            F.col(complete_date).between(F.lit(since), F.lit(as_of)) & F.col(status).isin(*done)
            & (F.col("complete_lbs") != missing_lbs) & (F.col("picked_lbs") > 0) & (F.col(loss_op) != excluded_op)
        ) for b in bases
    ]
    both = stack(kept)
    return both.join(calendar, both[complete_date] == calendar["calendar_date"], "left").drop("calendar_date")


def with_trailing_flags(df: DataFrame, date: str, as_of: dt.date) -> DataFrame:
    return df.select("*", F.date_sub(F.lit(as_of), 1).alias("run_date"), *trailing_flags(F.col(date), as_of))


def sum_measures(df: DataFrame, dims: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Job rows to a coarser grain."""
    return df.groupBy(*dims).agg(*[F.sum(m).alias(m) for m in measures])


def job_extract(df: DataFrame, date: str, as_of: dt.date, columns: Sequence[str]) -> DataFrame:
    """Narrow extract of the jobs completed the day before."""
    return df.filter(F.col(date) == F.date_sub(F.lit(as_of), 1)).select(*columns)
