"""Near-equal embeddings by a forest of random-projection trees with overlapping leaves.

Every tree splits the vectors again and again: a random direction, a random quantile near the middle as threshold,
and a margin on both sides of it within which vectors go to both children (spill). The margin is half the standard
deviation of the projected distance of a pair at the cosine limit, so a pair is rarely parted by all trees. A node
that a split cannot part, as more than half of its vectors lie within the margin, stays a leaf. Thresholds are fitted
on a bounded sample; directions come from the seed and the node's number, so a tree is a few numbers. All vectors are
routed through all trees and compared, in double precision, with the others of their leaves.

A sample can tell only so many leaves apart. Leaves that are still crowded go on growing by trees of their own, a few
levels at a time, each fitted in a task on a sample of that leaf, until they are small or a split hardly makes them
smaller. So the size of leaves follows the parameter and not the number of vectors.

Equal vectors are one class with a multiplicity. A leaf larger than ``block``, such as a dense one that no split parts,
is cut into blocks and compared block by block, so leaf size is no limit. No pair leaves a task: a pair counts in the
first leaf that it shares, each task returns per vector its number of links and its smallest linked vector, and
components are found from these.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths do not link. Repeated rows count as vectors of their own. Null ids are never the smallest. Extra columns are
not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebook.llm.batches import add_columns
from orebook.llm.components import components, least_linked
from orebook.session import cut

#: Vectors (and bytes) of the sample that thresholds are fitted on, trees, aimed leaf size, rows of a block.
SAMPLE, SAMPLE_BYTES, TREES, LEAF, BLOCK, SEED = 20_000, 2**26, 6, 2048, 2048, 20240
LEAST_SPLIT = 32
#: A leaf of more than CROWDED times the aimed size grows by the levels it needs, SUB_DEPTH at most, fitted on about
#: SUB_SAMPLE of its vectors; a leaf so made grows again if it is crowded and lost a tenth of the vectors by that.
CROWDED, SUB_DEPTH, SUB_SAMPLE, SHRINKS = 4, 5, 1024, 0.9
#: Leaves are numbered by vector length and tree above these bits, by node or path below them.
NODE_BITS = 40


def direction(dim: int, tree: int, node: int) -> np.ndarray:
    d = np.random.default_rng([SEED, dim, tree, node]).standard_normal(dim)
    return d / np.linalg.norm(d)


def margin(dim: int, cosine: float) -> float:
    return 0.5 * math.sqrt(max(0.0, 2 - 2 * cosine)) / math.sqrt(dim)


def fit(sample: np.ndarray, depth: int, tree: int, cosine: float) -> dict[int, float]:
    """Thresholds by node (1 is the root, 2n and 2n + 1 the children of n); other nodes are leaves."""
    dim, cuts = sample.shape[1], {}
    spill, rng = margin(dim, cosine), np.random.default_rng([SEED, dim, tree])
    todo = [(1, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if node.bit_length() > depth or len(rows) < LEAST_SPLIT:
            continue
        at = sample[rows] @ direction(dim, tree, node)
        threshold = float(np.quantile(at, rng.uniform(0.45, 0.55)))
        left, right = at <= threshold + spill, at > threshold - spill
        if (left & right).sum() * 2 <= len(rows):
            cuts[node] = threshold
            todo += [(2 * node, rows[left]), (2 * node + 1, rows[right])]
    return cuts


def route(vectors: np.ndarray, cuts: dict[int, float], tree: int, cosine: float) -> list[tuple[int, np.ndarray]]:
    """The leaves that the vectors fall into, each with its row numbers."""
    dim = vectors.shape[1]
    spill, out, todo = margin(dim, cosine), [], [(1, np.arange(len(vectors)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node not in cuts:
            out.append((node, rows))
            continue
        at = vectors[rows] @ direction(dim, tree, node) - cuts[node]
        todo += [(2 * node, rows[at <= spill]), (2 * node + 1, rows[at > -spill])]
    return out


def unit(packed: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors of packed vectors of one length, in double precision."""
    x = np.frombuffer(b"".join(packed), kind).astype(np.float64).reshape(len(packed), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(df: DataFrame, vector: str) -> tuple[DataFrame, str]:
    """``df`` with ``vec``, the components as bytes (null where the vector cannot link), and the kind of number."""
    kind = "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"
    fine = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    typed = df.withColumn("__v", F.when(fine, F.col(vector)) if kind == "<f4" else F.when(fine, F.col(vector).cast("array<double>")))

    def make():
        return lambda values: ((None if v is None else (np.array(v, kind) + 0.0).astype(kind).tobytes(),) for v in values)

    return add_columns(typed, ["__v"], T.StructType([T.StructField("vec", T.BinaryType())]), make).drop("__v"), kind


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9,
                 trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``df``: the id, ``n_links``, ``component_id`` and ``kept``."""
    rows, kind = packed(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")), "v")
    rows = cut(rows.drop("v").withColumn("digest", F.when(F.col("vec").isNotNull(), F.sha2("vec", 256))), "vectors")
    classes = cut(rows.where("vec is not null").groupBy("digest").agg(
        F.min("id").alias("id"), F.count("vec").alias("n"), F.first("vec").alias("vec")), "classes")
    forest = _fit(classes, kind, cosine, trees, leaf, sample)
    routed = cut(_routed(classes, df.sparkSession.sparkContext.broadcast(forest), kind, cosine, trees), "routed")
    routed = _grown(classes, routed, kind, cosine, leaf)
    spread = routed.select("digest", "n", "vec", "leaves", F.explode("leaves").alias("leaf"))
    # One row per leaf, written so that its size is known when the join is planned.
    sizes = cut(spread.groupBy("leaf").agg(F.ceil(F.count("n") / block).cast("int").alias("blocks")), "leaves")
    parts = (spread.join(sizes, "leaf")
             .withColumn("own", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    pairs = parts.select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "digest", "n", "vec", "leaves")
    links = cut(pairs.groupBy("leaf", "i", "j").applyInArrow(
        _compare(kind, cosine), "digest string, links long, least string"), "links")
    counted = links.groupBy("digest").agg(F.sum("links").alias("links"))
    groups = components(links, "digest", "least")
    # The smallest id of a component: digests name the classes, ids only the result.
    member = (classes.join(groups, F.col("digest") == F.col("node"), "left")
              .select("digest", "n", "id", F.coalesce("component", "digest").alias("g")))
    least = member.groupBy("g").agg(F.min("id").alias("component_id"))
    named = member.join(least, "g").join(counted, "digest", "left").select(
        "digest", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(named, "digest", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _fit(classes: DataFrame, kind: str, cosine: float, trees: int, leaf: int, sample: int) -> dict[int, list[dict[int, float]]]:
    """Per vector length the thresholds of each tree, from a sample by digest that is bounded in rows and bytes."""
    width = np.dtype(kind).itemsize
    sizes = classes.groupBy(F.length("vec").alias("bytes")).agg(F.count("n").alias("n")).orderBy(F.desc("n")).limit(64).collect()
    forest = {}
    for r in sizes:
        most = max(1, min(sample, SAMPLE_BYTES // r["bytes"] // len(sizes)))
        share = min(1.0, most / r["n"])
        drawn = classes.where((F.length("vec") == r["bytes"]) & (F.pmod(F.xxhash64("digest"), F.lit(10**6)) < share * 10**6))
        x = [b.vec for b in drawn.select("vec").limit(most + most // 4).collect()]
        depth = max(0, math.ceil(math.log2(r["n"] / leaf)))
        x = unit([bytes(b) for b in x], kind) if x else np.empty((0, r["bytes"] // width))
        forest[r["bytes"] // width] = [fit(x, depth, t, cosine) for t in range(trees)]
    return forest


def _routed(classes: DataFrame, forest, kind: str, cosine: float, trees: int) -> DataFrame:
    """``classes`` with ``leaves``: for each tree the leaves, numbered through trees and lengths."""
    width = np.dtype(kind).itemsize

    def make():
        def rows(vectors):
            leaves: list[list[int]] = [[] for _ in vectors]
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v) // width, []).append(i)
            for dim, some in by_dim.items():
                x = unit([vectors[i] for i in some], kind)
                for tree, cuts in enumerate(forest.value.get(dim, [{}])):
                    for node, at in route(x, cuts, tree, cosine):
                        for k in at:
                            leaves[some[k]].append((dim * trees + tree) << NODE_BITS | node)
            return ((x,) for x in leaves)

        return rows

    return add_columns(classes, ["vec"], T.StructType([T.StructField("leaves", T.ArrayType(T.LongType()))]), make)


def child(leaf: int, node: int) -> int:
    """The number of a node below a leaf. Two paths that meet in one number are compared together, which loses nothing."""
    path = hashlib.blake2b(f"{leaf}/{node}".encode(), digest_size=NODE_BITS // 8).digest()
    return leaf >> NODE_BITS << NODE_BITS | int.from_bytes(path)


def _grown(classes: DataFrame, routed: DataFrame, kind: str, cosine: float, leaf: int) -> DataFrame:
    """``routed`` with crowded leaves split by trees of their own."""
    first = placed = routed.select("digest", F.explode("leaves").alias("leaf"), F.lit(None).cast("long").alias("parent"))
    while True:
        sizes = placed.groupBy("leaf").agg(F.count("digest").alias("size"), F.max("parent").alias("parent"))
        shrinks = F.col("parent").isNull() | (F.col("size") < F.col("parent") * SHRINKS)
        crowded = cut(sizes.where((F.col("size") > CROWDED * leaf) & shrinks).select("leaf", "size"), "crowded")
        if crowded.isEmpty():
            break
        moving = placed.select("digest", "leaf").join(crowded, "leaf")
        drawn = moving.where(F.pmod(F.xxhash64("digest", "leaf"), F.lit(10**6)) < F.lit(10**6 * SUB_SAMPLE) / F.col("size"))
        vectors = classes.select("digest", "vec")
        cuts = cut(drawn.join(vectors, "digest").select("leaf", "size", "vec").groupBy("leaf", "size").applyInArrow(
            _fit_leaf(kind, cosine, leaf), "leaf long, nodes array<int>, cuts array<double>"), "sub-trees")
        moved = _moved(moving.join(vectors, "digest").join(cuts, "leaf").sortWithinPartitions("leaf"), kind, cosine)
        placed = cut(placed.join(cuts.select("leaf"), "leaf", "left_anti").select("digest", "leaf", "parent").union(moved), "placed")
    if placed is first:
        return routed
    # The leaves of a vector: as many as trees and margins give it, whatever the number of vectors.
    leaves = placed.groupBy("digest").agg(F.collect_set("leaf").alias("leaves"))
    return cut(routed.drop("leaves").join(leaves, "digest"), "grown")


def _fit_leaf(kind: str, cosine: float, aimed: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        crowded, size = (k.as_py() for k in key)
        depth = min(SUB_DEPTH, math.ceil(math.log2(size / aimed)))
        cuts = fit(unit(group.column("vec").to_pylist(), kind), depth, crowded, cosine)
        return pa.table({"leaf": pa.array([crowded], pa.int64()), "nodes": pa.array([list(cuts)], pa.list_(pa.int32())),
                         "cuts": pa.array([list(cuts.values())], pa.list_(pa.float64()))})

    return run


def _moved(moving: DataFrame, kind: str, cosine: float) -> DataFrame:
    """Rows of ``digest``, the leaf below the one it was in, and the size of that one as ``parent``."""
    def make():
        def rows(vectors, leaves, nodes, cuts):
            into: list[list[int]] = [[] for _ in vectors]
            by_leaf: dict[int, list[int]] = {}
            for i, leaf in enumerate(leaves):
                by_leaf.setdefault(leaf, []).append(i)
            for leaf, some in by_leaf.items():
                x = unit([vectors[i] for i in some], kind)
                for node, at in route(x, dict(zip(nodes[some[0]], cuts[some[0]])), leaf, cosine):
                    for k in at:
                        into[some[k]].append(child(leaf, node))
            return ((x,) for x in into)

        return rows

    sent = add_columns(moving, ["vec", "leaf", "nodes", "cuts"], T.StructType([T.StructField("into", T.ArrayType(T.LongType()))]), make)
    return sent.select("digest", F.explode("into").alias("leaf"), F.col("size").alias("parent"))


def _shared(a: list[list[int]], b: list[list[int]], leaf: int) -> np.ndarray:
    """Which pairs share a leaf with a smaller number than ``leaf``."""
    number: dict[int, int] = {}

    def marks(rows):
        at = [(i, number.setdefault(x, len(number))) for i, row in enumerate(rows) for x in row if x < leaf]
        return at

    ma, mb = marks(a), marks(b)
    x, y = np.zeros((len(a), len(number)), np.float32), np.zeros((len(b), len(number)), np.float32)
    for m, at in ((x, ma), (y, mb)):
        if at:
            m[tuple(np.array(at).T)] = 1
    return x @ y.T > 0


def _compare(kind: str, cosine: float):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        leaf, i, j = (k.as_py() for k in key)
        own = group.column("own").to_numpy()
        digest, leaves = group.column("digest").to_pylist(), group.column("leaves").to_pylist()
        n = group.column("n").to_numpy()
        x = unit(group.column("vec").to_pylist(), kind)
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        near = x[left] @ x[right].T >= cosine
        if i == j:
            np.fill_diagonal(near, False)
        rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        near, left, right = near[np.ix_(rows, cols)], left[rows], right[cols]
        near &= ~_shared([leaves[k] for k in left], [leaves[k] for k in right], leaf)
        links = np.zeros(len(own), np.int64)
        links[left] += near @ n[right]
        if i != j:
            links[right] += near.T @ n[left]
        some = np.flatnonzero(links)
        name = np.array(digest, object)
        by_rank = np.argsort(name)
        rank = np.argsort(by_rank)
        least = name[by_rank[least_linked(near, rank[left], rank[right], len(name))[rank]]]
        return pa.table({"digest": pa.array(name[some], pa.string()), "links": pa.array(links[some], pa.int64()),
                         "least": pa.array(least[some], pa.string())})

    return run
