"""Running totals over groups of any size.

A window over a whole group puts that group into one task. Where the data hold a group too
large for that, it is cut along its own order into chunks, each summed by itself; the totals
of the chunks before it are then added. The chunk keys follow the order, so the result
equals the plain window:

* rows are shuffled by (group, chunk), a group of ordinary size being one chunk;
* only one row per chunk is gathered for the offsets, level by level;
* the join that brings the offsets back uses the partitioning the window already made.

Whether there are such groups is asked first, by counting. Without any, the plain window is
used: one shuffle. Both ways give the same rows in the same types. The list of large groups
is a table of its own: it has no limit, is never collected, and Spark plans its join by size.
Operators over the same facts share one count (``GroupSizes``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebook.session import cut

_KEY = "__chunk"
# A group is large when it holds more than LARGE_ROWS rows.
LARGE_ROWS = 1_000_000


def large_groups(df: DataFrame, keys: Sequence[str], large_rows: int = LARGE_ROWS) -> DataFrame:
    """Keys of the large groups. Counts rows: one job over the key columns, written once."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > large_rows)
    return cut(sizes.select(*keys), "large-groups")


class GroupSizes:
    """The large groups of a table, counted when first asked for and once for all who ask.

    A table of no more than ``large_rows`` rows holds no large group; its number of rows, which Spark takes from file
    footers where it can, tells so without a shuffle.
    """

    def __init__(self, table: DataFrame, keys: Sequence[str], large_rows: int = LARGE_ROWS):
        self.table, self.keys, self.large_rows = table, list(keys), large_rows

    @cached_property
    def large(self) -> DataFrame | None:
        """Keys of the large groups, None without any."""
        if self.table.count() <= self.large_rows:
            return None
        return _some(large_groups(self.table, self.keys, self.large_rows))


def _some(groups: DataFrame) -> DataFrame | None:
    return None if groups.isEmpty() else groups


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    measures: dict[str, Column],
    chunks: Sequence[Column],
    totals: bool = False,
    peaks: bool = False,
    attrs: DataFrame | None = None,
    sized_by: GroupSizes | None = None,
    large_rows: int = LARGE_ROWS,
) -> DataFrame:
    """``df`` with the running sum of every measure within ``group`` along ``order``.

    ``chunks`` are expressions that never decrease along ``order`` (nulls last), coarsest
    first, such as the day and then a range of order numbers. ``order`` must be total.
    ``totals`` adds ``<name>_total``, the sum over the group; ``peaks`` adds ``<name>_peak``,
    the highest running sum in the group. ``attrs``, one row per group, is joined by group.
    ``sized_by`` tells the sizes in place of a count of ``df`` by ``group``: those of a table that is cheaper to count
    or counted already, by some or all of ``group``, and not below those of ``df``.
    """
    if attrs is not None:
        attrs = attrs.dropna(subset=list(group))
    plain = _plain(df, group, order, measures, totals, peaks, attrs)
    sized_on = list(group) if sized_by is None else sized_by.keys
    large = _some(large_groups(df, group, large_rows)) if sized_by is None else sized_by.large
    if large is None:
        return plain
    marked = _attach(df, large.withColumn("__large", F.lit(True)), sized_on)
    out = _chunked(marked, df.columns, group, order, measures, chunks, totals, peaks, attrs)
    # Sums of sums are wider decimals; the totals are the same, so the types are as well.
    return out.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in plain.schema.fields])


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], chunks: Sequence[Column], name: str,
              large_rows: int = LARGE_ROWS) -> DataFrame:
    """``df`` with each row's place in its group along a total ``order``, from 1; large groups are counted in chunks."""
    counted = running_totals(df, group, order, {name: F.lit(1).cast("long")}, chunks, large_rows=large_rows)
    return counted.withColumn(name, F.col(name).cast("long"))


def trailing_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column], measures: dict[str, Column], chunks: Sequence[Column],
                  rows: int, block_rows: int = LARGE_ROWS, large_rows: int = LARGE_ROWS) -> DataFrame:
    """``df`` with the sums of every measure over the row and the ``rows`` - 1 rows before it in ``group`` along ``order``.

    Rows are numbered and cut into blocks of ``block_rows`` rows. A block also gets the last ``rows`` - 1 rows before it,
    its halo, so every frame lies in one block and no task holds more than a block and its halo. A sum over no
    value but null is null, as in a plain window.
    """
    halo = rows - 1
    if halo > block_rows:
        raise ValueError("a block must be no shorter than the rows before it that a frame needs")
    names = {f"__m_{n}": c for n, c in measures.items()}
    placed = positions(df.withColumns(names), group, order, chunks, "__place", large_rows)
    block = F.floor((F.col("__place") - 1) / block_rows)
    last = F.pmod(F.col("__place") - 1, F.lit(block_rows)) >= block_rows - halo
    both = placed.withColumn("__own", block).withColumn(
        "__block", F.explode(F.when(last, F.array(block, block + 1)).otherwise(F.array(block))))
    frame = Window.partitionBy(*group, "__block").orderBy("__place").rowsBetween(-halo, 0)
    summed = both.withColumns({n: F.sum(f"__m_{n}").over(frame) for n in measures})
    return summed.filter("__own = __block").select(*[F.col(f"`{c}`") for c in df.columns], *measures)


def _plain(df, group, order, measures, totals, peaks, attrs) -> DataFrame:
    whole = Window.partitionBy(*group)
    upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    # The window meets plain columns: an expression would be evaluated again per frame.
    out = df.withColumns({f"__m_{n}": F.coalesce(c, zero) for n, c in measures.items()})
    out = out.withColumns({n: F.sum(f"__m_{n}").over(upto) for n in measures})
    if totals:
        out = out.withColumns({f"{n}_total": F.sum(f"__m_{n}").over(whole) for n in measures})
    if peaks:
        out = out.withColumns({f"{n}_peak": F.max(n).over(whole) for n in measures})
    out = out.drop(*[f"__m_{n}" for n in measures])
    return out if attrs is None else out.join(attrs, list(group), "left")


def _chunked(df, columns, group, order, measures, chunks, totals, peaks, attrs) -> DataFrame:
    levels = [f"__c{i}" for i in range(len(chunks))]
    names = list(measures)
    sums = [f"__m_{n}" for n in names]
    zero = F.lit(0)

    base = df.withColumns({
        "__g": F.struct(*group),
        **{lv: F.when(F.col("__large"), c) for lv, c in zip(levels, chunks)},
        **{f"__m_{n}": F.coalesce(c, zero) for n, c in measures.items()},
    }).withColumn(_KEY, F.struct("__g", *levels))
    within = Window.partitionBy(_KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({f"__r_{n}": F.sum(f"__m_{n}").over(within) for n in names})

    # Offsets are needed for the chunks of large groups only, unless every group has an extra.
    every_group = totals or peaks or attrs is not None
    summed = local if peaks else base if every_group else base.filter("__large")
    per_chunk = summed.groupBy(_KEY).agg(
        *[F.sum(s).alias(s) for s in sums], *[F.max(f"__r_{n}").alias(f"__x_{n}") for n in names if peaks],
    ).select(f"{_KEY}.*", *sums, *[f"__x_{n}" for n in names if peaks])
    offsets = _offsets(per_chunk, levels, sums)
    if peaks:
        top = per_chunk.select("__g", *levels, *[f"__x_{n}" for n in names])
        top = _attach(offsets, top, ["__g", *levels]).groupBy("__g").agg(
            *[F.max(F.col(f"__m_{n}__before") + F.col(f"__x_{n}")).alias(f"{n}_peak") for n in names]
        )
        offsets = _attach(offsets, top, ["__g"])
    carried = []
    if attrs is not None:
        carried = [c for c in attrs.columns if c not in group]
        offsets = _attach(offsets, attrs.select(F.struct(*group).alias("__g"), *carried), ["__g"])
    extra = [f"{n}_total" for n in names if totals] + [f"{n}_peak" for n in names if peaks] + carried
    if totals:
        offsets = offsets.withColumns({f"{n}_total": F.col(f"__m_{n}__total") for n in names})
    offsets = offsets.select(F.struct("__g", *levels).alias(_KEY), *[f"{s}__before" for s in sums], *extra)
    return local.join(offsets, _KEY, "left").select(
        *columns, *[(F.coalesce(F.col(f"__m_{n}__before"), zero) + F.col(f"__r_{n}")).alias(n) for n in names], *extra,
    )


def _offsets(totals: DataFrame, levels: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Per chunk the sum of every chunk before it in its group, and the group's own total.

    ``totals`` holds one row per (group, levels); each pass sums away the last level.
    """
    if not levels:
        return totals.select(
            "__g", *[(F.col(s) - F.col(s)).alias(f"{s}__before") for s in sums],
            *[F.col(s).alias(f"{s}__total") for s in sums],
        )
    parent, last = ["__g", *levels[:-1]], levels[-1]
    above = _offsets(totals.groupBy(*parent).agg(*[F.sum(s).alias(s) for s in sums]), levels[:-1], sums)
    before = Window.partitionBy(*parent).orderBy(F.col(last).asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    here = totals.select(
        *parent, last, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}__here") for s in sums]
    )
    return _attach(here, above, parent).select(
        *parent, last,
        *[(F.col(f"{s}__here") + F.col(f"{s}__before")).alias(f"{s}__before") for s in sums],
        *[f"{s}__total" for s in sums],
    )


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with null equal to null, right columns appended."""
    a, b = left.alias("a"), right.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys])
    extra = [F.col(f"b.`{c}`") for c in right.columns if c not in keys]
    return a.join(b, same, "left").select("a.*", *extra)
