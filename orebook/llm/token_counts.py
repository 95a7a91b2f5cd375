"""Token counts by a digest cache.

Each text gets the SHA-256 of its normalised content (runs of blanks, tabs, line ends become one space, ends cut:
the tokenizer does the same, so equal digests have equal counts). The cache is a Parquet table of
(tokenizer_digest, content_digest, n_tokens), where the tokenizer's digest is that of its file. Distinct digests
without a stored count are encoded once each, appended to the cache, and every row takes its count from the cache.

Null text counts as empty (0 tokens); repeated texts are encoded once; an empty table appends nothing; columns that
bear a new name are replaced. Texts are shuffled once, already distinct per task. Appends are whole Parquet
commits, so a lost executor repeats its task and a failed run leaves no half-written counts; a count that two runs
appended at the same time is read once.
"""

from __future__ import annotations

import hashlib

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebook.llm.batches import Memo, add_columns

CACHE = T.StructType([
    T.StructField("tokenizer_digest", T.StringType()),
    T.StructField("content_digest", T.StringType()),
    T.StructField("n_tokens", T.LongType()),
])
COUNT = T.StructType([T.StructField("n_tokens", T.LongType())])
BLANKS = str.maketrans("\t\n\r", "   ")
WORDS_KEPT = 400_000


class Counter:
    """Counts tokens with the tokenizers library, word by word.

    The tokenizer drops white space and no token, special or not, reaches over it, so a text has the tokens of its
    blank-separated words; most words recur, and their counts are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = Memo(self._count, WORDS_KEPT)

    def _count(self, word: str) -> int:
        return len(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        n = sum(map(self.words.__getitem__, text.translate(BLANKS).split(" ")))
        self.words.trim()
        return n


_COUNTERS: dict[str, Counter] = {}


def _counter(name: str) -> Counter:
    if name not in _COUNTERS:
        _COUNTERS[name] = Counter(SparkFiles.get(name))
    return _COUNTERS[name]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content(text):
    """The normalised content that is digested."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+", " "))


def read_cache(spark, cache: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer, one row per digest; empty where nothing has been stored yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    stored = spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, tokenizer: str, cache: str, text: str = "text") -> DataFrame:
    """``df`` with ``content_digest`` and ``n_tokens``; encodes and appends what the cache at ``cache`` lacks."""
    spark, version = df.sparkSession, tokenizer_digest(tokenizer)
    spark.sparkContext.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]

    def make():
        counter = _counter(name)
        return lambda texts: ((counter.count(t),) for t in texts)

    made = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    made = made.select(F.sha2(content(F.col("__text")), 256).alias("content_digest"), "__text")
    misses = (made.dropDuplicates(["content_digest"])
              .join(read_cache(spark, cache, version), "content_digest", "left_anti"))
    (add_columns(misses, ["__text"], COUNT, make)
     .select(F.lit(version).alias("tokenizer_digest"), "content_digest", "n_tokens")
     .write.mode("append").parquet(cache))
    kept = df.drop("content_digest", "n_tokens").withColumn("content_digest", F.sha2(content(F.col(f"`{text}`")), 256))
    return kept.join(read_cache(spark, cache, version), "content_digest", "left")
