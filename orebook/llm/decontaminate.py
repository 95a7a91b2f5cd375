"""Benchmark decontamination by Wu-Manber search over words.

Each benchmark item gives its windows of ten consecutive words (a shorter item is one window of its own length).
Windows of one length share a shift table: it tells, for the last two words read, how far the search may jump before
a window could end. Only where the jump is zero are the windows with this ending looked up and compared word by
word. The item texts are read in blocks of bounded size. Driver and tasks hold the tables of one block at a time: the
first pass writes the documents with a row number, every further pass writes only the rows it hits, and these are
joined in the end. A benchmark of one block needs neither the copy nor the join.

Null or wordless texts have no words and no hits; a wordless item has no window; items that share a window are all
reported; an item without an id marks words but is not reported. Repeated rows are searched each; rows and other
columns are kept, columns that bear a new name are replaced. Whole texts are searched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebook.llm.batches import add_columns
from orebook.session import cut

#: Words of a window; bytes of item text whose tables a task holds at a time, as objects up to 150 times as large.
WINDOW, BLOCK_BYTES = 10, 2 * 2**20
#: Byte by byte: A-Z lowered; digits, letters and everything beyond ASCII stay; the rest separates words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(T.LongType())),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class WuManber:
    """Search for word windows; ``windows`` maps each window (a tuple of words) to its item ids."""

    def __init__(self, windows: dict[tuple, set]):
        self.by_length = []
        for size in sorted({len(w) for w in windows}):
            block = min(2, size)
            jump: dict[tuple, int] = {}
            ends: dict[tuple, list] = {}
            for window, items in windows.items():
                if len(window) == size:
                    for end in range(block, size + 1):
                        part = window[end - block:end]
                        jump[part] = min(jump.get(part, size), size - end)
                    ends.setdefault(window[-block:], []).append((list(window), items))
            self.by_length.append((size, block, jump, ends))

    def search(self, words: list[bytes]) -> tuple[set[int], set]:
        """Positions of the words inside any occurrence, and the items found."""
        hit: set[int] = set()
        found: set = set()
        for size, block, jump, ends in self.by_length:
            most, end, n, jump_of = size - block + 1, size, len(words), jump.get
            while end <= n:
                last = tuple(words[end - block:end])
                far = jump_of(last, most)
                if far:
                    end += far
                    continue
                for window, items in ends[last]:
                    if words[end - size:end] == window:
                        hit.update(range(end - size, end))
                        found |= items
                end += 1
        return hit, found


def windows_of(items: list[tuple], size: int) -> dict[tuple, set]:
    out: dict[tuple, set] = {}
    for key, text in items:
        words = words_of(text)
        n = min(size, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            out.setdefault(tuple(words[at:at + n]), set()).update([] if key is None else [str(key)])
    return out


def find_windows(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (positions, ascending) and ``item_ids`` (as text, ascending)."""
    items = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    volume = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-volume // block_bytes))
    if blocks == 1:
        return _pass(docs, text, _send(items), size)
    row = "__row"
    while row in docs.columns:
        row += "_"
    hits = []
    for block in range(blocks):
        sent = _send(items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block))
        if block == 0:
            # The row numbers are fixed by being written.
            first = cut(_pass(docs.withColumn(row, F.monotonically_increasing_id()), text, sent, size), "first-block")
        else:
            found = _pass(first.select(row, F.col(f"`{text}`")), text, sent, size)
            hits.append(cut(found.where(F.size("hit_words") > 0).select(row, "hit_words", "item_ids"), "block"))
        sent.destroy()  # what the pass found is written
    lists = ("hit_words", "item_ids")
    more = reduce(DataFrame.union, hits).groupBy(F.col(row).alias("__of")).agg(
        *[F.flatten(F.collect_list(c)).alias(f"__more_{c}") for c in lists])
    both = first.join(more, F.col(row) == F.col("__of"), "left")
    return both.withColumns({
        c: F.array_sort(F.array_union(c, F.coalesce(f"__more_{c}", F.slice(c, 1, 0)))) for c in lists
    }).select(*[F.col(f"`{c}`") for c in first.columns if c != row])


def _send(items: DataFrame):
    """The items of one block, of bounded size, for the tasks of one pass."""
    return items.sparkSession.sparkContext.broadcast([(r.id, r.text) for r in items.collect()])


def _pass(docs: DataFrame, text: str, sent, size: int) -> DataFrame:
    def make():
        search = WuManber(windows_of(sent.value, size)).search

        def rows(texts):
            for t in texts:
                words = words_of(t)
                hit, ids = search(words)
                yield len(words), sorted(hit), sorted(ids)

        return rows

    return add_columns(docs, [text], FOUND, make)


def report(found: DataFrame) -> DataFrame:
    """Counts and the digest of the item ids in place of the lists of ``find_windows``."""
    return (found
            .withColumn("n_hit", F.size("hit_words").cast("long"))
            .withColumn("n_items", F.size("item_ids").cast("long"))
            .withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256))
            .withColumn("contaminated", F.size("hit_words") > 0)
            .drop("hit_words", "item_ids"))
