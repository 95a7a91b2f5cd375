"""Ranked lexical search over a length-stratified index.

A document's normaliser m follows from its number of terms alone, and documents with equal m are a stratum. Strata are
laid out by m in shards of about ``SHARD_TERMS`` terms; a stratum beyond that is dealt over several shards, so a length
that a third of all documents have lands in many tasks. Within a shard each term has its postings by stratum, and by tf
within the stratum; the impact of a posting depends on m and tf only and is worked out once for each such pair.

A search visits, for each item and shard, the strata by their bounds (for every term of the item the impact of its
greatest tf there, times the term's weight). Once the item has ``top`` documents, strata whose bound is below the worst of
their scores are left out; equal bounds are visited, as ties go to the smaller id. Each shard gives its best documents,
from which the best of all are taken. Items are read in blocks of bounded size, each block's result is written first.

Terms are maximal runs of ASCII letters, digits and anything beyond ASCII, A-Z lowered; whole texts are read. Null and
empty texts have no terms and are no documents of the index. Documents without an id count in all statistics, but are not
listed. Repeated rows are documents of their own; repeated items are searched each; items without terms get nothing;
extra columns are not read; an empty table gives an empty index and no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebook.llm.batches import add_columns
from orebook.llm.decontaminate import words_of
from orebook.session import cut, shared_path

#: Terms of the documents of a shard; bytes of the items searched at once.
SHARD_TERMS, BLOCK_BYTES = 2_000_000, 4 * 2**20
COUNTED = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("terms", T.StringType()),
    T.StructField("tfs", T.ArrayType(T.IntegerType())),
])
POSTINGS = "shard int, term string, n_docs long, numbers array<int>, tfs array<int>"


@dataclass(frozen=True)
class Index:
    """``postings`` (shard, term, n_docs, numbers, tfs) and ``documents`` (shard, number, m, id) under a path."""

    path: str

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{table}")


def _count(texts):
    for text in texts:
        counts = Counter(words_of(text))
        yield sum(counts.values()), b" ".join(counts).decode("utf-8", "surrogatepass"), list(counts.values())


def stratified(df: DataFrame, id_col: str, text_col: str, shard_terms: int) -> DataFrame:
    """Documents with terms: ``id``, ``n``, ``terms``, ``tfs``, ``m`` and ``shard``."""
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = cut(add_columns(docs, ["text"], COUNTED, lambda: _count).drop("text")
                  .withColumn("row", F.monotonically_increasing_id()).where("n > 0"), "terms")
    total = counted.agg(F.count("n").alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).first()
    m = counted.withColumn("m", F.expr(f"50 + (50 * n * {total.docs}L) div {total.terms}L"))
    # One row per distinct normaliser: shards are cut along the running number of terms.
    strata = m.groupBy("m").agg(F.sum("n").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strata = strata.select("m", F.expr(f"cast(ceil(size / {shard_terms}) as int)").alias("parts"), before.alias("before"))
    first = F.expr(f"cast(before div {shard_terms} as int)")
    return m.join(strata, "m").select(
        "id", "n", "terms", "tfs", "m", (first + F.pmod(F.xxhash64("row"), "parts").cast("int")).alias("shard"))


def _by_stratum(group: pa.Table) -> np.ndarray:
    """Row numbers by m, then id, rows without an id last."""
    return np.array(group.select(["m", "id"]).append_column("at", pa.array(np.arange(group.num_rows))).sort_by(
        [("m", "ascending"), ("id", "ascending"), ("at", "ascending")]).column("at"))


def build(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> Index:
    """Write the index of all documents of ``df`` to ``path``."""
    docs = cut(stratified(df, id_col, text_col, shard_terms), "strata")
    # Numbers run through a shard by stratum: a stratum is a range of numbers.
    numbered = docs.select("shard", "m", "id").withColumn(
        "number", F.row_number().over(Window.partitionBy("shard").orderBy("m", F.col("id").asc_nulls_last())).cast("int") - 1)
    numbered.write.parquet(f"{path}/documents")

    def postings(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        order, number = _by_stratum(group), defaultdict(lambda: len(number))
        terms, tfs = group.column("terms").take(order), group.column("tfs").take(order)
        term = [np.fromiter(map(number.__getitem__, t.as_py().split(" ")), np.int64) for t in terms]
        doc = np.repeat(np.arange(len(term)), [len(t) for t in term])
        m = np.array(group.column("m"))[order][doc]
        term, tf = np.concatenate(term), np.concatenate([np.array(c.flatten()) for c in tfs.chunks])
        by = np.lexsort((doc, tf, m, term))
        start = np.searchsorted(term[by], np.arange(len(number) + 1)).astype(np.int32)

        def lists(values):
            return pa.ListArray.from_arrays(pa.array(start), pa.array(values[by].astype(np.int32)))

        return pa.table({
            "shard": pa.array(np.full(len(number), key[0].as_py(), np.int32)), "term": pa.array(list(number), pa.string()),
            "n_docs": pa.array(np.diff(start).astype(np.int64)), "numbers": lists(doc), "tfs": lists(tf)})

    docs.select("shard", "m", "id", "terms", "tfs").groupBy("shard").applyInArrow(postings, POSTINGS).write.parquet(f"{path}/postings")
    return Index(path)


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Shard:
    """Postings of a shard, cut into segments: one per term and stratum, by tf."""

    def __init__(self, terms: list[str], numbers: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray):
        """``m``: the normaliser by document number, ascending."""
        self.strata, self.of_doc = np.unique(m, return_inverse=True)
        self.docs_of = np.bincount(self.of_doc, minlength=len(self.strata))
        self.number = np.concatenate(numbers)
        tf, stratum = np.concatenate(tfs).astype(np.int64), self.of_doc[self.number]
        pair, at = np.unique(stratum * (tf.max() + 1) + tf, return_inverse=True)  # each (m, tf) once
        self.impact = impact(pair % (tf.max() + 1), self.strata[pair // (tf.max() + 1)])[at]
        ends = np.cumsum([len(x) for x in numbers])
        term = np.repeat(np.arange(len(terms)), [len(x) for x in numbers])
        self.start = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])]))
        self.end = np.append(self.start[1:], len(term))
        self.stratum, self.greatest = stratum[self.start], self.impact[self.end - 1]
        cuts = np.searchsorted(self.start, np.concatenate([[0], ends]))
        self.segments = {t: np.arange(a, b) for t, a, b in zip(terms, cuts[:-1].tolist(), cuts[1:].tolist())}

    def best(self, weights: list[tuple[str, int]], top: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of all documents that may be among the ``top`` best: those with the top-th score or more."""
        held = [(self.segments[t], w) for t, w in weights if w and t in self.segments]
        if not held:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        segments = np.concatenate([s for s, _ in held])
        weight = np.repeat(np.array([w for _, w in held], np.int64), [len(s) for s, _ in held])
        bounds = np.zeros(len(self.strata), np.int64)
        np.add.at(bounds, self.stratum[segments], weight * self.greatest[segments])
        score = np.zeros(len(self.of_doc), np.int64)
        order, worst, at, some = np.argsort(-bounds, kind="stable"), 1, 0, 4 * top
        while at < len(order) and bounds[order[at]] >= worst:
            # The next strata in the order of bounds, with twice as many documents each time.
            to = at + 1 + int(np.searchsorted(np.cumsum(self.docs_of[order[at:]]), some))
            chosen = np.zeros(len(self.strata), bool)
            chosen[order[at:to]] = bounds[order[at:to]] >= worst
            mine = chosen[self.stratum[segments]]
            start, w = self.start[segments[mine]], weight[mine]
            sizes = self.end[segments[mine]] - start
            posting = np.repeat(start - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            np.add.at(score, self.number[posting], self.impact[posting] * np.repeat(w, sizes))
            if np.count_nonzero(score) >= top:
                worst = max(1, int(np.partition(score, len(score) - top)[len(score) - top]))
            at, some = to, 2 * some
        found = np.flatnonzero(score >= worst)
        return found, score[found]


def _weights(index: Index, spark: SparkSession, items: dict[int, set[str]], docs: int) -> dict[int, list[tuple[str, int]]]:
    """Terms with weights of the items of a block; only terms of the block come to the driver."""
    every = sorted(set().union(*items.values()))
    wanted = spark.createDataFrame(pa.table({"term": pa.array(every, pa.string())}))
    df = {r.term: r.df for r in index.read(spark, "postings").select("term", "n_docs").join(F.broadcast(wanted), "term", "left_semi")
          .groupBy("term").agg(F.sum("n_docs").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for t, n in df.items()}
    return {i: [(t, weight[t]) for t in sorted(terms) if t in weight] for i, terms in items.items()}


def search(index: Index, items: DataFrame, top: int = 50, item_id: str = "item_id", text_col: str = "text",
           id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ``top`` best documents with a score above 0."""
    spark = items.sparkSession
    documents = index.read(spark, "documents")
    docs = documents.count()
    kind = documents.schema["id"].dataType.simpleString()
    asked = cut(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
                .where("text is not null").withColumn("item", F.monotonically_increasing_id()), "items")
    volume = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-volume // block_bytes))
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # bounded by the number of blocks
        terms = {r.item: {w.decode("utf-8", "surrogatepass") for w in words_of(r.text)} for r in part}
        sent = spark.sparkContext.broadcast(_weights(index, spark, terms, docs))
        some = cut(_search_block(index, spark, sent, sorted(set().union(*terms.values())), top, kind), "found")
        found = some if found is None else found.union(some)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("item", "item_id"), "item").select(
        F.col("item_id").alias(item_id), "rank", F.col("id").alias(id_col), "score")


def _search_block(index: Index, spark: SparkSession, sent, terms: list[str], top: int, kind: str) -> DataFrame:
    wanted = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string())}))
    postings = index.read(spark, "postings").join(F.broadcast(wanted), "term", "left_semi")

    def rank(key: tuple[pa.Scalar, ...], held: pa.Table, docs: pa.Table) -> pa.Table:
        docs = docs.sort_by("number")
        ids = docs.column("id").combine_chunks()
        known = np.array(ids.is_valid())
        by_id = np.empty(len(ids), np.int64)
        by_id[np.array(pa.compute.sort_indices(ids))] = np.arange(len(ids))
        out: list[tuple] = []
        if held.num_rows:
            shard = Shard(held.column("term").to_pylist(), *[[np.array(x.values) for x in held.column(c)] for c in ("numbers", "tfs")],
                          np.array(docs.column("m")))
            for item, weights in sent.value.items():
                # Documents without an id are not listed and may not take a listed one's place.
                number, score = shard.best(weights, top + int((~known).sum()))
                number, score = number[known[number]], score[known[number]]
                first = np.lexsort((by_id[number], -score))[:top]
                out.append((np.full(len(first), item), number[first], score[first]))
        item, number, score = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
        return pa.table({"item": pa.array(item.astype(np.int64)), "id": ids.take(pa.array(number)), "score": pa.array(score.astype(np.int64))})

    return postings.groupBy("shard").cogroup(index.read(spark, "documents").groupBy("shard")).applyInArrow(
        rank, f"item long, id {kind}, score long")


def rank_all(df: DataFrame, items: DataFrame, top: int = 50, **names: str) -> DataFrame:
    """Build an index of ``df`` in the shared folder and search it."""
    return search(build(df, shared_path(df.sparkSession, "index")), items, top, **names)
