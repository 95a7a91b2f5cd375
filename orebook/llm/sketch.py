"""Document fingerprints by threshold-scaled sketches.

A sketch keeps every hash of a five-word shingle below a fixed fraction (``FRACTION``) of the hash range, so sketches
of texts of any size can be compared, merged and cut down to a lower threshold, and the part of a small text that is
held in a large one is estimated as well as the likeness of two equal ones. A text with fewer than ``LEAST`` hashes below
the fraction keeps its ``LEAST`` smallest ones with the threshold they reach (all of them where it has no more, and then
every estimate against a text that keeps all, too, is exact). Two sketches are compared below the lower of their thresholds.

Words are runs of anything but ASCII white space, as they are written; fewer than five words are one shingle. Null texts
count as empty: no words, an empty sketch, like only another empty one. Equal texts have equal fingerprints. Very long
texts are read whole. Everything is built-in functions.

``compare_with_next`` follows the order of ids. Rows that share an id each have the same next text; of rows that share
the next id the text whose beginning sorts first is taken. After the largest id comes the smallest; rows without an id
are followed by an empty text. Extra columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebook.session import cut

SHINGLE, LEAST, FRACTION = 5, 16, 1 / 8
#: Hashes have 62 bits.
ALL = 2**62
#: Ids that one task puts in order.
BLOCK_ROWS = 500_000
WHITE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of the shingles of an array of words, 62 bits each; repeated shingles repeat."""
    def of(*some):
        return F.shiftrightunsigned(F.xxhash64(*some), 2)

    long = F.transform(F.sequence(F.lit(0), F.size(words) - shingle), lambda i: of(*[F.get(words, i + k) for k in range(shingle)]))
    return (F.when(F.size(words) >= shingle, long).when(F.size(words) > 0, F.array(of(words)))
            .otherwise(F.array().cast("array<bigint>")))


def sketch(hashes: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """Struct of ``threshold`` and ``kept``: the distinct hashes below it, ascending."""
    limit = int(ALL * fraction)

    def made(threshold, kept):
        return F.struct(F.lit(threshold).cast("long").alias("threshold"), kept.alias("kept"))

    def small(every):
        return (F.when(F.size(every) <= least, made(ALL, every))
                .otherwise(made(F.get(every, F.lit(least - 1)) + 1, F.slice(every, 1, least))))

    def chosen(low):
        every = F.sort_array(F.array_distinct(hashes))
        return F.when(F.size(low) >= least, made(limit, low)).otherwise(F.get(F.transform(F.array(every), small), F.lit(0)))

    low = F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < limit)))
    return F.get(F.transform(F.array(low), chosen), F.lit(0))


def with_sketch(df: DataFrame, text: str, into: str, shingle: int = SHINGLE, fraction: float = FRACTION, least: int = LEAST) -> DataFrame:
    """``df`` with the sketch of ``text`` in ``into``; words and hashes are worked out once each."""
    split = df.withColumn("__words", words(F.col(f"`{text}`"))).withColumn("__hashes", hashes(F.col("__words"), shingle))
    return split.withColumn(into, sketch(F.col("__hashes"), fraction, least)).drop("__words", "__hashes")


def _below(one: Column, threshold: Column) -> Column:
    return F.filter(one["kept"], lambda h: h < threshold)


def _common(a: Column, b: Column, of: Column | None) -> Column:
    """Shared hashes below the lower threshold, as a part of those of ``of``, or of both where it is None."""
    low = F.least(a["threshold"], b["threshold"])
    both = F.size(F.array_intersect(_below(a, low), _below(b, low)))
    whole = F.size(_below(a, low)) + F.size(_below(b, low)) - both if of is None else F.size(_below(of, low))
    return F.when(whole > 0, both / whole)


def likeness(a: Column, b: Column) -> Column:
    """Estimated size of the intersection by that of the union; two empty sketches are alike."""
    return F.coalesce(_common(a, b, None), F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated part of the first text's shingles that the second one has; null where the first has none to tell."""
    return _common(a, b, a)


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts together, below the lower threshold."""
    low = F.least(a["threshold"], b["threshold"])
    return F.struct(low.alias("threshold"), F.sort_array(F.array_union(_below(a, low), _below(b, low))).alias("kept"))


def as_text(one: Column) -> Column:
    """The fingerprint as a string: threshold, colon, hashes, in hexadecimal."""
    return F.concat(F.hex(one["threshold"]), F.lit(":"), F.array_join(F.transform(one["kept"], F.hex), ","))


def next_ids(sizes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``sizes`` (distinct ``id`` without nulls) with ``next_id``, the following id; after the last comes the first.

    Ids are dealt out by range; each range is ordered by itself, and its last id gets the first one of the next range
    that holds any. The table of ranges has one row per task.
    """
    sizes = cut(sizes, "ids")
    parts = max(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes.count() // block_rows))
    dealt = cut(sizes.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "ranges")
    order = Window.orderBy("part")
    firsts = dealt.groupBy("part").agg(F.min("id").alias("first")).select("part", F.coalesce(
        F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    follows = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return (dealt.withColumn("follows", follows).join(firsts, "part")
            .withColumn("next_id", F.coalesce("follows", "after")).drop("part", "follows", "after"))


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4) -> DataFrame:
    """Each row's id with ``text``, ``edited`` (its last 1 / ``part`` of code points replaced by the first as many of the
    next text), and the sketches ``own``, ``own_edited`` and ``following`` (of the next text).

    Texts are shuffled once, by id, for both joins: only the beginning of the next text and its sketch travel again. Both
    joins read the same rows, those with an id, so that Spark reuses the exchange.
    """
    every = with_sketch(df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), "text", "own")
    docs = every.where("id is not null")
    wanted = (df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).alias("n"))
              .where("id is not null").groupBy("id").agg(F.expr(f"max(n) div {part}").cast("int").alias("take")))
    pairs = next_ids(wanted).select(F.col("id").alias("prev"), F.col("next_id").alias("id"), "take")
    given = (docs.join(pairs, "id").select("prev", F.struct(F.expr("substring(text, 1, take)").alias("head"), F.col("own").alias("own")).alias("next"))
             .groupBy("prev").agg(F.min("next").alias("next")))
    out = docs.join(given.withColumnRenamed("prev", "id"), "id", "left").unionByName(every.where("id is null"), allowMissingColumns=True)
    moved = f"cast(length(text) div {part} as int)"
    out = out.withColumn("edited", F.expr(
        f"concat(substring(text, 1, length(text) - {moved}), coalesce(substring(next.head, 1, {moved}), ''))"))
    out = with_sketch(out, "edited", "own_edited")
    empty = F.struct(F.lit(ALL).cast("long").alias("threshold"), F.array().cast("array<bigint>").alias("kept"))
    return out.select(F.col("id").alias(id_col), "text", "edited", "own", "own_edited", F.coalesce("next.own", empty).alias("following"))
