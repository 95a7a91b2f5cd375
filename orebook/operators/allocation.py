"""Inventory allocation: demand scope, running balances by site, cross-site cover, hot items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebook.functions.numbers import pick_by_site
from orebook.operators.joins import scope_expand
from orebook.operators.rollup import json_list, null_last_key, ordered_text, pivot_fixed
from orebook.operators.running import LARGE_ROWS, GroupSizes, running_totals
from orebook.session import cut

# Pipeline states, stage order, and the job states that mean complete.
NO_MATERIAL, AVAILABLE, STARTED, COMPLETE, UNKNOWN = (
    "No Material", "Material Available", "Job Started", "Job Complete", "Unknown",
)
STATUS_ORDER = (AVAILABLE, STARTED, COMPLETE, NO_MATERIAL)
ALL_COMPLETE = "^(Complete|Closed)(,(Complete|Closed))*$"


def on_hand_name(site: str) -> str:
    return f"on_hand_{site}"


def tally_name(site: str) -> str:
    return f"tally_{site}"


def floor_name(site: str) -> str:
    return f"floor_{site}"


def stock_by_site(stock: DataFrame, item: str, site: str, qty: str, sites: Sequence[str]) -> DataFrame:
    """On hand per item, one column per site."""
    return pivot_fixed(stock, [item], site, {s: on_hand_name(s) for s in sites}, F.coalesce(F.col(qty), F.lit(0)))


def pipeline_status(in_scope: Column, required: Column, job_status: Column, short: Column) -> Column:
    """Where a line stands; null out of scope."""
    return (
        F.when(~in_scope, F.lit(None))
        .when((required == 0) & job_status.rlike(ALL_COMPLETE), COMPLETE)
        .when(required == 0, STARTED)
        .when(short, NO_MATERIAL)
        .when(required > 0, AVAILABLE)
        .otherwise(UNKNOWN)
    )


def demand_scope(lines: DataFrame, in_scope: Column, by: Sequence[str], staged: DataFrame, staged_on: Sequence[str],
                 stock: DataFrame, item: str, notes: DataFrame, notes_on: str) -> DataFrame:
    """Scoped lines and their competition, with staged lots, stock by site and the latest notes.

    ``staged`` has (keys, item, lot), ``stock`` one row per item, ``notes`` (snapshot_date, key, texts).
    """
    lots = staged.groupBy(*staged_on).agg(
        F.min("assembly").alias("assembly"), ordered_text("lot", ["lot"], ", ").alias("assembly_lots")
    )
    texts = [c for c in notes.columns if c not in ("snapshot_date", notes_on)]
    latest = notes.agg(F.max("snapshot_date")).scalar()
    newest = notes.filter(F.col("snapshot_date") == latest).groupBy(F.trim(notes_on).alias(notes_on)).agg(
        *[F.max(F.trim(t)).alias(t) for t in texts]
    )
    return (
        scope_expand(lines, in_scope, by)
        .join(lots, list(staged_on), "left")
        .join(stock, item, "left")
        .join(newest, notes_on, "left")
    )


def allocation_tally(
    lines: DataFrame, stock: DataFrame, sites: Sequence[str], item: str, site: str, required: str,
    order: Sequence[Column], chunks: Sequence[Column], sized_by: GroupSizes | None = None,
    large_rows: int = LARGE_ROWS,
) -> DataFrame:
    """First come, first served: the balance of every site after each line of an item.

    ``stock`` holds one row per item with ``on_hand_<site>`` columns. Per line come
    ``tally_<site>``, ``floor_<site>`` (lowest balance over all lines of the item), the home
    site's ``tally_home`` and ``is_short`` (both null for a site not listed). A busy item is
    cut into chunks, so its size does not matter.
    """
    need = F.coalesce(F.col(required), F.lit(0))
    used = {f"__used_{s}": F.when(F.col(site) == s, need).otherwise(F.lit(0)) for s in sites}
    out = running_totals(lines, [item], order, used, chunks, peaks=True, attrs=stock, sized_by=sized_by,
                         large_rows=large_rows)
    on_hand = {s: F.coalesce(F.col(on_hand_name(s)), F.lit(0)) for s in sites}
    out = out.withColumns({
        **{tally_name(s): on_hand[s] - F.col(f"__used_{s}") for s in sites},
        **{floor_name(s): on_hand[s] - F.col(f"__used_{s}_peak") for s in sites},
    })
    home = pick_by_site(F.col(site), {s: F.col(tally_name(s)) for s in sites})
    out = out.withColumn("tally_home", home)
    short = pick_by_site(F.col(site), {s: (F.col(tally_name(s)) < 0) & (F.col(required) > 0) for s in sites})
    dropped = [n for s in sites for n in (f"__used_{s}", f"__used_{s}_peak")]
    return out.withColumn("is_short", short).drop(*dropped)


def home_tally(lines: DataFrame, stock: DataFrame, item: str, site: str, required: str, order: Sequence[Column],
               chunks: Sequence[Column], sized_by: GroupSizes | None = None, large_rows: int = LARGE_ROWS) -> DataFrame:
    """Only the home site's balance: ``stock`` has one row per (item, site) with ``on_hand``.
    ``sized_by`` tells the sizes by item."""
    out = running_totals(lines, [item, site], order, {"__used": F.coalesce(F.col(required), F.lit(0))}, chunks,
                         attrs=stock, sized_by=sized_by, large_rows=large_rows)
    return out.withColumn("tally_home", F.coalesce(F.col("on_hand"), F.lit(0)) - F.col("__used")).drop("__used")


def cross_site_match(tally: DataFrame, sites: Sequence[str], item: str, site: str, required: str, unit: str,
                     ties: Sequence[Column], chunks: Sequence[Column], sized_by: GroupSizes | None = None,
                     large_rows: int = LARGE_ROWS) -> DataFrame:
    """Short lines of a site against the surplus of another, smallest lines first.

    The floors of all sites are on every line of the tally, so covering is counted per donor
    column in one pass over the short lines; only (item, short site, donor) rows are formed.
    ``chunks`` follow ``ties`` within one required quantity. ``sized_by`` tells the sizes by item.
    """
    r = F.col(required)
    donors = tally.groupBy(item).agg(*[F.coalesce(F.bool_or(F.col(site) == s), F.lit(False)).alias(f"__has_{s}") for s in sites])
    short = tally.filter("is_short").select(
        item, site, unit, required, *[floor_name(s) for s in sites],
        *[c.alias(f"__t{i}") for i, c in enumerate(ties)], *[c.alias(f"__k{i}") for i, c in enumerate(chunks)],
    )
    ranked = running_totals(
        short, [item, site], [r.asc_nulls_last(), *[F.col(f"__t{i}") for i in range(len(ties))]],
        {"__cum": r}, [r, *[F.col(f"__k{i}") for i in range(len(chunks))]],
        sized_by=sized_by, large_rows=large_rows,
    )
    fits = {s: F.col("__cum") <= F.col(floor_name(s)) for s in sites}
    per_unit = ranked.groupBy(item, site, unit).agg(
        F.count(F.lit(1)).alias("lines_short"), F.sum(required).alias("total_short_qty"),
        *[F.max(floor_name(s)).alias(f"__floor_{s}") for s in sites],
        *[F.count(F.when(fits[s], 1)).alias(f"__lines_{s}") for s in sites],
        *[F.max(F.when(fits[s], F.col("__cum"))).alias(f"__need_{s}") for s in sites],
    )
    # From here on the rows are (item, site, unit): a few per item.
    at_site, at_item = Window.partitionBy(item, site), Window.partitionBy(item)
    per_donor = per_unit.join(donors, item).select(
        F.col(item), F.col(unit), F.col(site).alias("short_site"), "lines_short", "total_short_qty",
        F.sum("total_short_qty").over(at_site).alias("__site_short"),
        F.sum("total_short_qty").over(at_item).alias("__item_short"),
        F.array(*[
            F.struct(
                F.lit(s).alias("donor_site"), F.col(f"__has_{s}").alias("has"),
                F.col(f"__floor_{s}").alias("floor"),
                F.sum(f"__lines_{s}").over(at_site).alias("lines"),
                F.max(f"__need_{s}").over(at_site).alias("need"),
                F.coalesce(F.sum(F.when(F.col(site) == s, F.col("total_short_qty"))).over(at_item), F.lit(0)).alias("own"),
            ) for s in sites
        ]).alias("__donors"),
    )
    d = F.col("__d")
    return per_donor.withColumn("__d", F.explode("__donors")).filter(
        d["has"] & (d["floor"] > 0) & (d["donor_site"] != F.col("short_site"))
    ).select(
        item, unit, "short_site", "lines_short", "total_short_qty", d["donor_site"].alias("donor_site"),
        d["floor"].alias("donor_available_qty"), d["lines"].alias("lines_coverable"),
        F.coalesce(d["need"], F.lit(0)).alias("qty_needed"),
        F.round(d["lines"].cast("double") / F.nullif(F.col("lines_short"), F.lit(0)) * 100, 1).alias("lines_coverage_pct"),
        (d["lines"] == F.col("lines_short")).alias("full_lines_cover"),
        (F.col("__item_short") - d["own"] > d["floor"]).alias("donor_overcommitted"),
    )


def cross_site_extract(match: DataFrame) -> DataFrame:
    """Pairs that cover something, the share as a fraction."""
    return match.filter("lines_coverage_pct > 0").withColumn("lines_coverage_pct", F.col("lines_coverage_pct") / 100)


def net_available(stock: DataFrame, demand: DataFrame, keys: Sequence[str], on_hand: str, required: str) -> DataFrame:
    """Stock less committed demand per key, positive balances only; both sides are summed before the join."""
    have = stock.groupBy(*keys).agg(F.sum(on_hand).alias("__have"))
    need = demand.groupBy(*keys).agg(F.sum(F.coalesce(F.col(required), F.lit(0))).alias("__need"))
    out = have.join(need, list(keys), "left").select(
        *keys, (F.col("__have") - F.coalesce(F.col("__need"), F.lit(0))).alias("net_available")
    )
    return out.filter("net_available > 0")


def hot_items(tally: DataFrame, supply: DataFrame, elsewhere: DataFrame, sites: Sequence[str],
              other_sites: Sequence[str], item: str, site: str, required: str, unit: str) -> DataFrame:
    """Short items with their short lines per site, open supply and free stock elsewhere.

    ``supply`` has (item, due_date, site, vendor, qty); ``elsewhere`` (item, site, net_available).
    """
    short = tally.filter("is_short").groupBy(item).agg(
        F.max(unit).alias("uom"), F.count(F.lit(1)).alias("total_lines_short"),
        F.sum(required).alias("total_qty_short"),
        *[F.count(F.when(F.col(site) == s, 1)).alias(f"lines_short_{s}") for s in sites],
    )
    # Three readers: written once, so that the tally is not worked out three times.
    short = cut(short, "short-items")
    items = short.select(item)
    details = supply.join(items, item, "left_semi").groupBy(item).agg(
        json_list(
            [*null_last_key(F.col("due_date")), F.col("site"), F.col("vendor"), F.col("qty")],
            [F.date_format("due_date", "yyyy-MM-dd").alias("date"), F.col("site"), F.col("vendor"), F.col("qty")],
        ).alias("supply_details")
    )
    free = pivot_fixed(elsewhere.join(items, item, "left_semi"), [item], site,
                       {s: f"available_{s}" for s in other_sites}, F.col("net_available"))
    out = short.join(details, item, "left").join(free, item, "left")
    return out.withColumns({f"available_{s}": F.coalesce(F.col(f"available_{s}"), F.lit(0)) for s in other_sites})


def backlog_status(lines: DataFrame, site: str, status: str, usd: str) -> DataFrame:
    return lines.groupBy(site, status).agg(F.count(F.lit(1)).alias("line_count"), F.sum(usd).alias("total_usd"))


def split_shipments(lines: DataFrame, in_scope: Column, shipment: str, columns: Sequence[str]) -> DataFrame:
    """Scoped lines beyond the first shipment, to be cancelled."""
    return lines.filter(in_scope & (F.col(shipment).cast("int") > 1)).select(*columns)
