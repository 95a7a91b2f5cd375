"""Near duplicates by SuperMinHash, banding, verification and union-find.

A document's set holds its distinct word shingles as 64-bit hashes (fewer words than a shingle: the whole sequence as
one). In a SuperMinHash signature each shingle visits the positions in an order of its own, a permutation, and offers
rank + fraction: ranks differ within a shingle, which correlates the positions and lowers the variance of the
estimate; a document stops as soon as no later rank can lower any position. Bands of the signature are buckets.

Equal sets are one class from the start, so copies cost one row. Classes are the nodes of the graph; ids come in only for
the result. In each bucket the members are compared with one pivot, the member that shares most buckets with others (of a
group of copies, mostly the original); every candidate is verified on the full sets, and linked documents are grouped.
Buckets whose members are then in different groups are compared whole, block by block, inside tasks that return only
which members belong together. So no pair leaves a task, no candidate is dropped, and two documents of one bucket end in
one group if, and only if, links lead from one to the other. A bucket of k blocks sends each of its texts to k tasks; blocks
are bounded in documents and in shingles. The members of buckets of more than ``WIDE`` blocks are dealt out anew, by the rare
shingles that any two linked sets must share (prefix filter): this moves each of their shingles a fixed number of times, and
documents that all are just below the limit meet in no bucket any more.
With 20 bands of 4 a pair at 0.85 is missed by all bands once in 2.5 million.

Rows without words, null text included, are linked with nothing. Rows that share an id, and rows without one, are compared
as any others; a group's id is the smallest one in it, null where none of its rows has an id. Repeated rows get equal
results. Extra columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebook.llm.batches import Memo, add_columns, give_back
from orebook.llm.components import components, least_linked
from orebook.session import cut

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
STEP = 0x9E3779B97F4A7C15
BASE = np.uint64(STEP)
WORDS_KEPT, ELEMENTS_AT_ONCE, SETS_KEPT, COLUMNS_AT_ONCE = 200_000, 150_000, 64, 4096
#: Documents of a block, shingles for which a longer document counts once more, blocks of a bucket that is compared whole.
BLOCK, COUNTED, WIDE = 512, 2000, 8
SIGNED = T.StructType([
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_digest", T.BinaryType()),
    T.StructField("buckets", T.ArrayType(T.LongType())),
])


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Turns texts into sorted arrays of distinct shingle hashes."""

    def __init__(self, size: int):
        self.size = size
        self.words = Memo(xxhash.xxh3_64_intdigest, WORDS_KEPT)

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # splits at ASCII white space
        if not words:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        self.words.trim()
        k = min(self.size, len(w))
        out = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            out = out * BASE + w[i:len(w) - k + 1 + i]
        return np.unique(mix(out))


def super_minhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` values per set; rows of empty sets are infinite."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    best = np.full(len(sets) * size, np.inf)
    order = None
    for rank in range(size):
        draw = mix(element + np.uint64(STEP * (rank + 1) % 2**64))
        swap = rank + ((mix(draw + BASE) >> np.uint64(32)) * np.uint64(size - rank) >> np.uint64(32)).astype(np.int64)
        if order is None:
            place = swap
        else:
            rows = np.arange(len(element))
            place = order[rows, swap].astype(np.int64)
            order[rows, swap] = order[rows, rank]
        np.minimum.at(best, doc * size + place, rank + (draw >> np.uint64(11)) * 2.0 ** -53)
        open_docs = best.reshape(-1, size).max(axis=1) >= rank + 1
        stays = open_docs[doc]
        if not stays.any():
            break
        doc, element = doc[stays], element[stays]
        if order is None:  # the first swap is known without a table, which only short documents need
            order = np.tile(np.arange(size, dtype=np.uint16), (len(element), 1))
            order[np.arange(len(element)), place[stays]] = 0
        else:
            order = order[stays]
    return best.reshape(-1, size)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), bands, signature.shape[1] // bands)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * BASE), (len(signature), bands))
    for i in range(bits.shape[2]):
        key = mix(key * BASE + bits[:, :, i])
    return key.view(np.int64)


def signatures(df: DataFrame, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """``df`` with the size and digest of the shingle set and one bucket key per band."""

    def make():
        shingles = Shingles(shingle)

        def sign(some):
            keys = band_keys(super_minhash(some, bands * rows), bands)
            for s, k in zip(some, keys):
                yield (len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), k.tolist()) if len(s) else (0, None, None)

        def work(texts):
            some, held = [], 0
            for t in texts:
                some.append(shingles.of(t))
                held += len(some[-1])
                if held >= ELEMENTS_AT_ONCE:
                    yield from sign(some)
                    some, held = [], 0
            yield from sign(some)

        return work

    return add_columns(df, [text], SIGNED, make)


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those ``pairs`` (a, b) whose sets have 100 * intersection >= percent * union. ``texts``: id, text, unique ids."""
    def run(batches):
        shingles, sets = Shingles(shingle), {}

        def of(key, text):
            if key not in sets:
                if len(sets) >= SETS_KEPT:
                    sets.clear()
                sets[key] = shingles.of(text)
            return sets[key]

        # Slices keep the Python copies of long texts small beside the batch itself.
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            good = []
            for a, ta, b, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = of(a, ta), of(b, tb)
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        sets = shingles = batch = x = y = None
        give_back()

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    full = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "ta", "b", "tb")
    return full.mapInArrow(run, pairs.select("a", "b").schema)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
                    bands: int = 20, rows: int = 4) -> DataFrame:
    """One row per row of ``df``: the id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``."""
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = cut(signatures(docs.withColumn("row", F.monotonically_increasing_id()), "text", shingle, bands, rows), "signed")
    groups = _groups(signed, shingle, percent).select("set_digest", F.col("first.id").alias("group_id"))
    out = signed.select("id", "n_shingles", "set_digest").join(groups, "set_digest", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("group_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
                         bands: int = 20, rows: int = 4) -> DataFrame:
    """``df`` with one row of each group: of the smallest id, and of repeated rows the first. Wordless rows all stay."""
    copy = df.withColumn("__row", F.monotonically_increasing_id())
    signed = cut(signatures(copy, text_col, shingle, bands, rows), "signed")
    short = signed.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col("__row").alias("row"),
                          "n_shingles", "set_digest", "buckets")
    first = _groups(short, shingle, percent).select(F.col("first.row").alias("__row")).distinct()
    stays = first.union(short.where("n_shingles = 0").select("row"))
    return signed.join(stays.hint("merge"), "__row", "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def _groups(signed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``set_digest`` and ``first`` of every class: its group's first row by id, rows without an id last.

    A class is named by its first row, whose text stands for it: equal sets compare alike.
    """
    classes = cut(signed.where("n_shingles > 0").groupBy("set_digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("first"), F.first("buckets").alias("buckets"), F.first("n_shingles").alias("n_shingles"))
        .withColumn("rep", F.col("first.row")), "classes")
    members = classes.select(F.explode("buckets").alias("bucket"), "rep").distinct()
    full = members.groupBy("bucket").agg(F.count("rep").alias("n")).where("n > 1")
    shared = cut(members.join(full, "bucket"), "buckets")
    degree = shared.groupBy("rep").agg(F.sum("n").alias("degree"))
    pivot = (shared.join(degree, "rep").groupBy("bucket")
             .agg(F.max_by("rep", F.struct("degree", "rep")).alias("pivot")))
    pairs = shared.join(pivot, "bucket").where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    tested = cut(pairs, "pairs")
    needed = shared.select(F.col("rep").alias("id")).distinct()
    # Both sides grow with the table; a small one is not to be joined in another way than a large one.
    texts = cut(signed.select(F.col("row").alias("id"), "text").join(needed.hint("merge"), "id", "left_semi"), "texts")
    links = cut(verify(tested, texts, shingle, percent), "verified")
    groups = components(links, "a", "b")
    mixed = _mixed(shared.where("n > 2"), groups, classes)
    wide = F.col("size") > WIDE * BLOCK
    rest = _compare_in_blocks(mixed.where(~wide), texts, shingle, percent)
    crowd = mixed.where(wide).select("id").distinct()
    if not crowd.isEmpty():
        dealt = _by_rare_shingles(texts.join(crowd.hint("merge"), "id", "left_semi"), shingle, percent)
        rest = rest.union(_compare_in_blocks(_mixed(dealt, groups, classes), texts, shingle, percent))
    groups = components(links.union(cut(rest, "verified")), "a", "b")
    named = (classes.join(groups, F.col("rep") == F.col("node"), "left")
             .select("set_digest", "first", F.coalesce("component", "rep").alias("component")))
    return named.drop("first").join(named.groupBy("component").agg(F.min("first").alias("first")), "component").drop("component")


def _mixed(shared: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Buckets whose members are in different groups; of buckets with equal members one is taken.

    ``size`` counts the documents to be compared with all others, ``others`` those compared with them alone (not ``short``).
    Where documents have more than ``COUNTED`` shingles on average, each ``COUNTED`` shingles count as one.
    """
    if "short" not in shared.columns:
        shared = shared.withColumn("short", F.lit(True))
    named = (shared.join(groups, F.col("rep") == F.col("node"), "left")
             .select("bucket", "rep", "short", F.coalesce("component", "rep").alias("g")))
    members = F.struct(F.count("rep"), F.sum(F.xxhash64("rep", "short").cast("decimal(20,0)")),
                       F.sum(F.hash("rep", "short").cast("long")))
    mixed = (named.groupBy("bucket").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), members.alias("same"))
             .where("lo < hi").groupBy("same").agg(F.min("bucket").alias("bucket")).select("bucket"))
    held = cut(named.join(mixed, "bucket").join(classes.select("rep", "n_shingles"), "rep")
               .select("bucket", F.col("rep").alias("id"), "short", "n_shingles"), "mixed")

    def counted(which):
        weight = F.coalesce(F.sum(F.when(which, F.col("n_shingles"))), F.lit(0))
        return F.greatest(F.count_if(which), F.ceil(weight / COUNTED))

    sizes = held.groupBy("bucket").agg(counted(F.col("short")).alias("size"), counted(~F.col("short")).alias("others"))
    return held.join(sizes, "bucket").select("bucket", "size", "others", "short", "id")


def _by_rare_shingles(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Buckets (``bucket``, ``rep``, ``short``) of ``texts`` (id, text): any two linked ones are in one, one of them ``short``.

    Shingles are ordered by the number of texts that hold them. A set of n shingles that is linked with a smaller one shares
    percent * n / 100 shingles with it, and 2 * percent * n / (100 + percent) with a larger one. So its first n - shared + 1
    shingles, a long head to find smaller sets and a short one to be found by larger ones, hold a shingle of the other's head.
    """
    def run(batches):
        shingles = Shingles(shingle)

        def table(ids, sets):
            sizes = [len(x) for x in sets]
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(np.repeat(np.array(sizes, np.int64), sizes)),
                pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "n", "bucket"])

        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            ids, sets, held = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(key)
                sets.append(shingles.of(text))
                held += len(sets[-1])
                if held >= ELEMENTS_AT_ONCE:
                    yield table(ids, sets)
                    ids, sets, held = [], [], 0
            if sets:
                yield table(ids, sets)
        batch = ids = sets = shingles = None
        give_back()

    each = cut(texts.select("id", "text").mapInArrow(run, "rep long, n long, bucket long"), "shingles")
    often = each.groupBy("bucket").agg(F.count("rep").alias("texts")).where("texts > 1")
    of_text = Window.partitionBy("rep")
    # Shingles that no other text holds come first and need no place of their own.
    place = (F.col("n") - F.count("bucket").over(of_text)
             + F.row_number().over(of_text.orderBy("texts", "bucket")))
    heads = (each.join(often, "bucket").withColumn("place", place)
             .where(f"place <= n - (n * {percent} + 99) div 100 + 1")
             .withColumn("short", F.expr(f"place <= n - (n * {2 * percent} + {99 + percent}) div {100 + percent} + 1")))
    heads = cut(heads.select("bucket", "rep", "short"), "heads")
    meet = heads.groupBy("bucket").agg(F.count("rep").alias("n"), F.max("short").alias("found")).where("n > 1 and found")
    return heads.join(meet, "bucket").select("bucket", "rep", "short")


def _parts(mixed: DataFrame) -> DataFrame:
    """Which members (``own``, ``id``) go to the task of the blocks (``i``, ``j``) of a bucket."""
    if "short" not in mixed.columns:
        mixed = mixed.withColumns({"short": F.lit(True), "others": F.lit(0)})
    first, more = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("size", "others"))
    place = lambda blocks: F.pmod(F.xxhash64("id"), F.greatest(blocks, F.lit(1))).cast("int")
    return (mixed.withColumn("own", F.when(F.col("short"), place(first)).otherwise(first + place(more)))
            .withColumn("other", F.explode(F.sequence(F.lit(0), first - 1 + F.when(F.col("short"), more).otherwise(0))))
            .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id"))


def _compare_in_blocks(mixed: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that join what is linked within each bucket; large buckets are compared block by block.

    Intersections of all pairs of a block are one matrix product over the shingles that occur in it more than once.
    """
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        shingles = Shingles(shingle)
        i, j = key[1].as_py(), key[2].as_py()
        ids, own = np.array(group.column("id").to_pylist(), object), group.column("own").to_numpy()
        by_id = np.argsort(ids)
        ids, own = ids[by_id], own[by_id]
        text = group.column("text")
        sets = [shingles.of(text[int(k)].as_py()) for k in by_id]
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        sizes = np.array([len(s) for s in sets])
        both = _intersections(sets)[np.ix_(left, right)]
        near = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
        least = least_linked(near, left, right, len(ids))
        some = np.flatnonzero(least != np.arange(len(ids)))
        kind = group.schema.field("id").type
        return pa.table({"a": pa.array(ids[least[some]], kind), "b": pa.array(ids[some], kind)})

    kind = texts.schema["id"].dataType.simpleString()
    return (_parts(mixed).join(texts, "id").groupBy("bucket", "i", "j").applyInArrow(run, f"a {kind}, b {kind}").distinct())


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[often] = np.arange(len(often))
    at = place[number]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)))
    for low in range(0, len(often), COLUMNS_AT_ONCE):
        some = slice(*np.searchsorted(at, [low, low + COLUMNS_AT_ONCE]))
        marks = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
        marks[owner[some], at[some] - low] = 1
        out += marks @ marks.T
    return out.astype(np.int64)
