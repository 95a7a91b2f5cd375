"""Connected components of a graph given as a DataFrame of links.

Union-find inside each task, over at most ``LOCAL_LINKS`` links, turns the links into stars. Then, until only stars to
the smallest node are left, every node hands its larger neighbours, and next its smaller ones, to the smallest node it knows. Each
step is a combinable minimum and a join, so a node with very many links is never gathered in one task, and each
round is written to the shared folder. Depth halves at least from round to round.

Links with a null end are ignored, a link to itself and repeated links change nothing, no links give an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebook.llm.batches import give_back
from orebook.session import cut

#: Links that one task joins by union-find.
LOCAL_LINKS = 250_000


def forest(pairs) -> dict:
    """Union-find over pairs: each node that is not its group's smallest, with that smallest node."""
    parent: dict = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _local(batches):
    held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if held is not None:
        found = forest(zip(held.column(0).to_pylist(), held.column(1).to_pylist()))
        kind = held.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(list(found), type=kind), pa.array(list(found.values()), type=kind)], names=["u", "v"])
    batches = held = found = None
    give_back()


def least_linked(near: np.ndarray, left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    """The smallest index reachable from each of ``count`` ones, where ``near[i, j]`` links ``left[i]`` and ``right[j]``."""
    least = np.arange(count)
    while near.size:
        before = least.copy()
        np.minimum.at(least, left, np.where(near, least[right][None, :], count).min(axis=1))
        np.minimum.at(least, right, np.where(near, least[left][:, None], count).min(axis=0))
        if (before == least).all():
            break
    return least


def _to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each neighbour v of u goes to the smallest node that u knows."""
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = _to_least(both.where("v > u"), least).union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = _to_least(large, least).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one node, and that one points to none."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("hub")).union(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("hub")))
    bad = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("hub").alias("hub")).where("out > 1 or (out = 1 and hub = 1)")
    return not bad.limit(1).count()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node that is not its component's smallest."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    pairs = cut(pairs.distinct(), "links")
    tasks = max(1, -(-pairs.count() // LOCAL_LINKS))
    edges = cut(pairs.coalesce(tasks).mapInArrow(_local, pairs.schema), "links")
    while tasks > 1 and not _stars(edges):
        edges = cut(_round(edges), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
