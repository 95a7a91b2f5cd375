"""Joins the domain needs: as-of, effective-dated, banded, scoped, top-one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebook.session import cut


def asof_values(keys: DataFrame, history: DataFrame, by: str, at: str, effective: str,
                values: Sequence[str]) -> DataFrame:
    """For every distinct (``by``, ``at``) the history row with the latest ``effective`` not after it.

    Keys and history are stacked and sorted once per ``by``; no pair of key and history row
    is formed. Only distinct dates reach the window, so its partitions stay as long as the
    calendar whatever the number of facts.
    """
    wanted = keys.select(F.col(by), F.col(at).alias("__at")).filter(F.col("__at").isNotNull()).distinct()
    known = history.groupBy(by, effective).agg(
        *[F.max_by(v, F.struct(*values)).alias(v) for v in values]
    )
    stacked = wanted.select(
        by, "__at", F.lit(1).alias("__side"), F.lit(None).cast("struct<" + ",".join(
            [f"`{effective}`:{history.schema[effective].dataType.simpleString()}"]
            + [f"`{v}`:{history.schema[v].dataType.simpleString()}" for v in values]) + ">").alias("__row"),
    ).unionByName(known.select(
        by, F.col(effective).alias("__at"), F.lit(0).alias("__side"), F.struct(effective, *values).alias("__row")
    ))
    w = Window.partitionBy(by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        stacked.withColumn("__row", F.last("__row", ignorenulls=True).over(w))
        .filter("__side = 1")
        .select(by, F.col("__at").alias(at), "__row.*")
    )


def asof_values_chunked(keys: DataFrame, history: DataFrame, by: str, at: str, effective: str, values: Sequence[str],
                        chunk: Callable[[Column], Column]) -> DataFrame:
    """:func:`asof_values` for times, where one ``by`` may hold most of the rows.

    ``chunk`` cuts time, never falling along it (an hour, a day). Keys and history are stacked and sorted by ``by`` and
    chunk; a key without a history row before it in its chunk gets the last one of an earlier chunk, which is carried
    along a table of one row per chunk. A task holds one chunk of one ``by``.
    """
    wanted = keys.select(F.col(by), F.col(at).alias("__at")).filter(F.col("__at").isNotNull()).distinct()
    known = history.filter(F.col(effective).isNotNull()).groupBy(by, effective).agg(*[F.max_by(v, F.struct(*values)).alias(v) for v in values])
    row = F.struct(effective, *values)
    kind = known.select(row.alias("r")).schema["r"].dataType
    rows = wanted.select(by, "__at", F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__row")).unionByName(
        known.select(by, F.col(effective).alias("__at"), F.lit(0).alias("__side"), row.alias("__row")))
    rows = rows.withColumn("__chunk", chunk(F.col("__at")))
    within = Window.partitionBy(by, "__chunk").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(by, "__chunk").agg(F.max(F.when(F.col("__side") == 0, F.struct("__at", "__row"))).alias("__last")).select(
        by, "__chunk", F.last("__last.__row", ignorenulls=True).over(before).alias("__carried"))
    found = rows.withColumn("__row", F.last("__row", ignorenulls=True).over(within)).filter("__side = 1")
    same = found[by].eqNullSafe(carried[by]) & (found["__chunk"] == carried["__chunk"])
    return found.join(carried.hint("merge"), same).select(
        found[by], F.col("__at").alias(at), F.coalesce("__row", "__carried").alias("__row")).select(by, at, "__row.*")


def asof_join(facts: DataFrame, history: DataFrame, by: str, at: str, effective: str,
              values: Sequence[str], chunk: Callable[[Column], Column] | None = None) -> DataFrame:
    """Facts with the values in force at their date; none in force leaves nulls. ``chunk`` cuts times, where ``at`` is one.

    The found values, one row per distinct key and date, are written to the shared folder
    first. Their size is then known, and Spark broadcasts them if they are small and shuffles
    by key and date if they are not, with a busy key split at run time.
    """
    args = (facts, history, by, at, effective, values)
    found = cut(asof_values(*args) if chunk is None else asof_values_chunked(*args, chunk), "asof")
    return facts.join(found, [by, at], "left")


def rate_enrich(rows: DataFrame, rates: DataFrame, currency: str, date: str, base_currency: str,
                rate_date: str = "rate_date", rate: str = "rate") -> DataFrame:
    """Exchange rate in force at the row's date; the base currency counts as 1."""
    out = asof_join(rows, rates, currency, date, rate_date, [rate])
    return out.withColumn(rate, F.when(F.col(currency) == base_currency, F.lit(1.0)).otherwise(F.col(rate)))


def latest_effective(facts: DataFrame, history: DataFrame, by: str, at: str, effective: str,
                     values: Sequence[str]) -> DataFrame:
    """Effective-dated attribute per row, as :func:`asof_join` without the effective date."""
    return asof_join(facts, history, by, at, effective, values).drop(effective)


def top_band(facts: DataFrame, keys: Sequence[str], bands: DataFrame, on: Sequence[str], measure: str,
             goal: str, band: str, carry: Sequence[str]) -> DataFrame:
    """The highest band whose goal the measure reaches; a row that reaches none stays without one.

    The bands that share a join key become one sorted array, so each fact meets one row and
    picks from it; nothing is ranked per fact.
    """
    steps = F.struct(F.col(band).alias("band"), F.col(goal).alias("goal"), *carry)
    ladder = bands.select(*on, steps.alias("__step")).groupBy(*on).agg(
        F.sort_array(F.collect_list("__step"), asc=False).alias("__bands")
    )
    reached = F.filter("__bands", lambda b: F.col(measure) >= b["goal"])
    out = facts.join(ladder, list(on), "left").withColumn("__top", F.try_element_at(reached, F.lit(1)))
    return out.select(
        *facts.columns, F.col("__top.band").alias(band), *[F.col(f"__top.{c}").alias(c) for c in carry]
    )


def scope_expand(lines: DataFrame, in_scope: Column, by: Sequence[str]) -> DataFrame:
    """Rows in scope, and the rows that compete with them for the same ``by`` key."""
    keys = lines.filter(in_scope).select(*by).distinct().withColumn("__scoped", F.lit(True))
    return lines.join(keys, list(by), "left").filter(in_scope | F.col("__scoped")).drop("__scoped")


def keep_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
             rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Each task drops all but its own first ``n`` before the shuffle."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def attach_dim(df: DataFrame, dim: DataFrame, key: str, dim_key: str, values: Sequence[str],
               normalise: bool = False) -> DataFrame:
    """Attributes of a dimension made unique by its trimmed, lower-cased key.

    The join is on the raw key unless ``normalise``; Spark broadcasts the dimension only if
    its own size estimate allows.
    """
    first = keep_top(dim.withColumn("__norm", F.trim(F.lower(dim_key))), ["__norm"],
                     [F.col(dim_key), *[F.col(v) for v in values]])
    right = first.select(
        (F.col("__norm") if normalise else F.col(dim_key)).alias("__key"), *values
    )
    left_key = F.trim(F.lower(df[key])) if normalise else df[key]
    return df.join(right, left_key == right["__key"], "left").drop("__key")
