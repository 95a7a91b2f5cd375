"""Jobs: grain, usage, BOM ratios, routes, links to order lines, earned hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebook.functions.numbers import ratio, to_lbs
from orebook.functions.text import linked_key
from orebook.operators.rollup import count_distinct_by, grain_rollup, ordered_text


def job_rollup(rows: DataFrame, job: str, first: Sequence[str], last: Sequence[str], cost: str, rate: str) -> DataFrame:
    """One row per job, its component cost in the base currency."""
    out = grain_rollup(rows, [job], first=first, last=[*last, cost, rate])
    return out.withColumn(f"{cost}_usd", F.col(cost) * F.col(rate))


def job_usage(rows: DataFrame, job: str, qty: str, uom: str, weight: str, cost: str | None = None,
              rate: str | None = None, name: str = "issued") -> DataFrame:
    """Issued or required quantity of a job in pounds, with its value where a cost is given."""
    last = [qty, uom, weight, *[c for c in (cost, rate) if c]]
    out = grain_rollup(rows, [job], last=last)
    cols = [F.col(job), F.col(qty), to_lbs(F.col(qty), F.col(uom), F.col(weight)).alias(f"{name}_lbs")]
    if cost:
        cols.append((F.col(cost) * F.col(rate)).alias(f"{name}_usd"))
    return out.select(*cols)


def bom_expected(bom: DataFrame, keys: Sequence[str], numerator: str, denominator: str) -> DataFrame:
    """Expected yield of a bill of material per key: ratio of the sums."""
    return bom.groupBy(*keys).agg(
        F.sum(numerator).alias(numerator), F.sum(denominator).alias(denominator),
        ratio(F.sum(numerator), F.sum(denominator)).alias("expected_yield"),
    )


def bom_expected_item(bom: DataFrame, keys: Sequence[str], numerator: str, denominator: str) -> DataFrame:
    """The same per item, where repeats of a line carry the same quantities: ratio of the maxima."""
    return bom.groupBy(*keys).agg(
        F.max(numerator).alias(numerator), F.max(denominator).alias(denominator),
        ratio(F.max(numerator), F.max(denominator)).alias("expected_yield"),
    )


def bom_type(bom: DataFrame, key: str, item: str, kinds: dict[str, Column]) -> DataFrame:
    """Distinct items per key, in all and by kind."""
    return count_distinct_by(bom, [key], item, "items", kinds)


def produced_qty(txn: DataFrame, keys: Sequence[str], qty: str) -> DataFrame:
    return txn.groupBy(*keys).agg(F.sum(qty).alias("complete_lbs"))


def picked_qty(txn: DataFrame, keys: Sequence[str], qty: str, cost: str) -> DataFrame:
    """Issues are booked negative; picked amounts are positive."""
    return txn.groupBy(*keys).agg(F.sum(-F.col(qty)).alias("picked_lbs"), F.sum(-F.col(cost)).alias("picked_usd"))


def route_steps(rows: DataFrame, job: str, sequence: str, code: str) -> DataFrame:
    """Distinct job, sequence and operation."""
    return rows.select(job, sequence, code).distinct()


def route_attribution(steps: DataFrame, job: str, sequence: str, code: str, names: DataFrame, ranks: DataFrame,
                      sep: str = " → ") -> DataFrame:
    """Route texts of a job and the operation its loss belongs to: the lowest rank on the route.

    One aggregate by job: the ranked operations of a job form a set no larger than the rank
    table, from which the owner is picked; steps are never joined to themselves. Among
    operations of the same rank the greatest code and name count. ``names`` has
    (op_code, op_name), ``ranks`` (op_name, rank).
    """
    named = steps.join(names, steps[code] == names["op_code"], "left").join(ranks, "op_name", "left")
    ranked = F.when(F.col("rank").isNotNull(), F.struct(F.col("rank").alias("r"), F.col(code).alias("c"), F.col("op_name").alias("n")))
    out = named.groupBy(job).agg(
        ordered_text(code, [sequence, code], sep).alias("op_codes"),
        ordered_text("op_name", [sequence, code], sep).alias("op_names"),
        F.collect_set(ranked).alias("__ops"), F.min("rank").alias("loss_rank"),
    )
    owners = F.filter("__ops", lambda o: o["r"] == F.col("loss_rank"))
    return out.select(
        job, "op_codes", "op_names", F.array_max(F.transform(owners, lambda o: o["c"])).alias("loss_op_code"),
        F.array_max(F.transform(owners, lambda o: o["n"])).alias("loss_op_name"), "loss_rank",
    )


def link_jobs(jobs: DataFrame, order: str, line: str, shipment: str, item: str) -> DataFrame:
    """Jobs with the order line they serve: the direct key, else the one inside the item text."""
    keep = [c for c in jobs.columns if c not in (order, line, shipment)]
    direct = {order: F.col(order), line: F.col(line), shipment: F.col(shipment)}
    return jobs.select(*keep, *linked_key(direct, F.col(item)))


def job_facts(rows: DataFrame, job: str, qty: str, expected: Column, issued: Column, sequence: str, code: str,
              firsts: dict[str, Column], sep: str = " → ") -> DataFrame:
    """Everything a link needs of a job from one aggregate: ``firsts`` (smallest values), ``expected_qty`` and ``issued_qty``
    (sums where the condition holds) and ``route`` (the distinct codes in order, null codes skipped)."""
    step = F.when(F.col(code).isNotNull(), F.struct(F.col(sequence).isNull().alias("n"), F.col(sequence).alias("s"), F.col(code).alias("c")))
    out = rows.groupBy(job).agg(
        *[F.min(c).alias(n) for n, c in firsts.items()],
        F.sum(F.when(expected, F.col(qty))).alias("expected_qty"), F.sum(F.when(issued, F.col(qty))).alias("issued_qty"),
        F.array_sort(F.collect_set(step)).alias("__steps"),
    )
    route = F.when(F.size("__steps") > 0, F.array_join(F.transform("__steps", lambda x: x["c"]), sep))
    return out.withColumn("route", route).drop("__steps")


def order_job_link(lines: DataFrame, jobs: DataFrame, expected: DataFrame, actual: DataFrame, routes: DataFrame,
                   on: Sequence[str], job: str) -> DataFrame:
    """Order lines with their jobs, usage and route. The inputs are at job grain already, so the
    three job joins share one partitioning by job and add no rows."""
    at_job = jobs.join(expected, job, "left").join(actual, job, "left").join(routes, job, "left")
    return lines.join(at_job, list(on), "left")


def earned_hours(rows: DataFrame, job: str, op: str, site: str, qty: str, hours: str,
                 formulas: Sequence[tuple[Column, Column]], manual: DataFrame, include: DataFrame) -> DataFrame:
    """Hours earned per job and operation: a formula where one applies, a manual figure over all.

    ``formulas`` are (condition, hours) pairs over ``site``, ``op``, the completed quantity and
    ``raw_hours``. ``manual`` has (job, op, manual_hrs); ``include`` (site, op, include).
    """
    out = rows.groupBy(job, op).agg(F.max(site).alias(site), F.max(qty).alias(qty), F.sum(hours).alias("raw_hours"))
    calc, applied = None, F.lit(False)
    for cond, value in formulas:
        calc = F.when(cond, value) if calc is None else calc.when(cond, value)
        applied = applied | cond
    calc = F.col("raw_hours") if calc is None else calc.otherwise(F.col("raw_hours"))
    out = out.withColumns({"calc_hours": calc, "calc_adjusted": applied})
    out = out.join(manual, [job, op], "left").join(include, [site, op], "left")
    return out.select(
        job, op, site, qty, "raw_hours", "calc_hours",
        F.coalesce("manual_hrs", "calc_hours").alias("earned_hours"),
        F.col("manual_hrs").isNotNull().alias("manual_adjusted"), "calc_adjusted", "include",
    )
