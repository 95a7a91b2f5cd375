"""Sharding by histogram sort.

Rows are ordered by the checksum of their text, then by a hash of id and row number (copies are neighbours, but even
one text that fills a third of the table can be cut anywhere). The exact bytes below candidate keys are counted over
all partitions at once: between the two best-known keys of each splitter lie ``PROBES`` evenly spaced ones; the next
round looks only between the two that enclose the wanted number of bytes. A splitter is done when it meets the
tolerance or no key is left between. Only counts reach the driver: shards * PROBES numbers a round, at most eleven
rounds for 63 bits. Then rows are exchanged once and numbered within their shard.

Rows without text count 8 bytes and have the checksum of the empty text; repeated rows are rows of their own; an
empty table gives an empty one; with fewer rows than shards some shards are empty. Carried columns may have any name but
those of the result, which replace them. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebook.session import cut

#: Candidate keys per splitter and round; error of a splitter in parts of a shard; rows numbered by one task.
PROBES, TOLERANCE, BLOCK_ROWS, OVERHEAD = 64, 0.0005, 500_000, 8
LOW_BITS = 31


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with ``size``, ``text_crc32`` and the sort key ``key`` (63 bits)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return (df.withColumn("size", (F.octet_length(text) + OVERHEAD).cast("long"))
            .withColumn("text_crc32", F.crc32(text))
            .withColumn("row_number", F.monotonically_increasing_id())
            .withColumn("key", F.shiftleft("text_crc32", LOW_BITS)
                        + F.xxhash64(F.col(f"`{id_col}`"), "row_number").bitwiseAND(2**LOW_BITS - 1)))


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Keys at which shards 1, 2, ... begin, so that bytes below them are near equal parts of all bytes."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wanted = [total * s // shards for s in range(1, shards)]
    # lo, bytes below lo, hi, bytes below hi
    spans = [(0, 0, 2**63 - 1, total)] * len(wanted)
    near = max(1, int(total / shards * tolerance))
    while True:
        todo = sorted({(lo, hi) for (lo, a, hi, b), w in zip(spans, wanted) if hi - lo > 1 and w - a > near and b - w > near})
        if not todo:
            return [lo if w - a <= b - w else hi for (lo, a, hi, b), w in zip(spans, wanted)]
        # Spans of one round are equal or apart, as all are cut at the same places.
        steps = [-(-(hi - lo) // PROBES) for lo, hi in todo]
        cell = F.coalesce(*[
            F.when((F.col("key") >= lo) & (F.col("key") < hi), F.expr(f"{i * PROBES} + (key - {lo}L) div {step}L"))
            for i, ((lo, hi), step) in enumerate(zip(todo, steps))])
        counts = dict(rows.select(cell.alias("cell"), "size").where("cell is not null").groupBy("cell").agg(F.sum("size")).collect())
        for s, (lo, a, hi, b) in enumerate(spans):
            if (lo, hi) in todo and wanted[s] - a > near and b - wanted[s] > near:
                at, below = todo.index((lo, hi)), a
                for k in range(PROBES):
                    here = counts.get(at * PROBES + k, 0)
                    if below + here >= wanted[s]:
                        step = steps[at]
                        spans[s] = (lo + k * step, below, min(hi, lo + (k + 1) * step), below + here)
                        break
                    below += here


def histogram_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple = (),
                     tolerance: float = TOLERANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row's id and ``carry`` columns with ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless, by key).

    Keys and sizes are written once, so that row numbers stay the same when a task is repeated.
    """
    kept = [c for c in dict.fromkeys([id_col, *carry]) if c == id_col or c not in ("size", "text_crc32", "shard", "slot")]
    named = {c: f"__kept{i}" for i, c in enumerate(kept)}
    plain = df.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    rows = cut(keyed(plain, named[id_col], "__text").drop("__text"), "keyed")
    starts = splitters(rows, shards, tolerance)
    shard = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        shard = F.when(F.col("key") < starts[s], s).otherwise(shard)
    dealt = rows.withColumn("shard", shard.cast("int"))
    # Shards are numbered in blocks of about block_rows rows, cut at quantiles of the key.
    blocks = min(1000, -(-rows.count() // (shards * block_rows)))
    if blocks > 1:
        cuts = dealt.groupBy("shard").agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks)], 100 * blocks).alias("cuts"))
        dealt = (dealt.join(F.broadcast(cuts), "shard")  # one row per shard
                 .withColumn("block", F.size(F.filter("cuts", lambda c: c < F.col("key")))).drop("cuts"))
    else:
        dealt = dealt.withColumn("block", F.lit(0))
    sizes = dealt.groupBy("shard", "block").agg(F.count("key").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "block").orderBy("key", "row_number")
    return (dealt.withColumn("slot", F.row_number().over(within) - 1)
            .join(F.broadcast(sizes), ["shard", "block"])  # at most shards * 1000 rows
            .withColumn("slot", (F.col("slot") + F.col("before")).cast("long"))
            .select(*[F.col(n).alias(c) for c, n in named.items()], "size", "text_crc32", "shard", "slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in the order of their slots."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
