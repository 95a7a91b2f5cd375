"""Byte-level BPE and cached token counts against the libraries, on odd and long texts."""

import base64
import hashlib
import os
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import types as T
from tokenizers import Tokenizer

from orebook.llm import bpe, token_counts
from orebook.llm.batches import add_columns

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ODD = [None, "", " ", "  \n\t ", "a", "it's we'll  x", "é ñ 中文 🙂 ٣ Ⅷ ͸", "\x1c \x1d\x85  ", "<|endoftext|> a<|startoftext|>b",
       "ab" * 5000, "=" * 4000, "word " * 3000, "tail   "]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(RANKS, "rb").read(), P.PATTERN)


def ids_of(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_random_texts_equal_the_library(codec, library):
    draw = random.Random(7)
    letters = list("aabcdeth  '1.!?\n\té中🙂") + ["'s", "  ", "ing", "　"]
    for _ in range(4000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        packed = codec.encode(text)
        assert ids_of(packed) == library.encode_ordinary(text)
        assert codec.decode(packed).decode() == text


def test_frame_keeps_rows_and_columns(spark, library):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)] + [(1, "a", 1)], "doc_id long, text string, n_tokens long")
    rows = bpe.encode_digests(df, RANKS, P.PATTERN).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, RANKS, P.PATTERN).drop("text"), RANKS).collect()
    assert {(r.doc_id, r.text) for r in back} == {(1, "a"), *((i, t or "") for i, t in enumerate(ODD))}


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, RANKS, P.PATTERN).count() == 0
    assert token_counts.count_tokens(none, WORDS, str(tmp_path / "cache")).count() == 0


def test_counts_and_the_cache(spark, tmp_path):
    library, cache = Tokenizer.from_file(WORDS), str(tmp_path / "cache")
    want = {t: len(library.encode(t or "", add_special_tokens=False).ids) for t in ODD}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD + ODD)], "doc_id long, text string")
    assert {(r.text, r.n_tokens) for r in token_counts.count_tokens(df, WORDS, cache).collect()} == set(want.items())
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == stored.select("content_digest").distinct().count() < len(ODD)  # blank texts share a digest
    # The second run finds everything stored, and believes it.
    version = token_counts.tokenizer_digest(WORDS)
    assert token_counts.count_tokens(df, WORDS, cache).count() == len(df.collect())
    assert spark.read.parquet(cache).count() == n
    digest = token_counts.read_cache(spark, cache, version).where("n_tokens > 0").first()
    assert digest.n_tokens in want.values()
    more = spark.createDataFrame([(1, "a new text"), (2, "a")], "doc_id long, text string")
    token_counts.count_tokens(more, WORDS, cache).collect()
    assert spark.read.parquet(cache).count() == n + 1
    assert token_counts.read_cache(spark, cache, "another version").count() == 0


def test_random_counts_equal_the_library():
    library, counter, draw = Tokenizer.from_file(WORDS), token_counts.Counter(WORDS), random.Random(3)
    letters = list("abcdeABC  '19.!?\n\téİΣςß中🙂\x1c\x85　́") + ["<|endoftext|>", "'s"]
    for _ in range(2000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_a_worker_gives_back_what_a_task_held(spark):
    """The memos of a task, and its batches, are no part of the worker that lives on."""
    def held(pid):
        return int(next(x for x in open(f"/proc/{pid}/status") if x.startswith("VmRSS")).split()[1]) / 1024

    df = spark.range(0, 3000, 1, 1).selectExpr("array_join(transform(sequence(1, 60), i -> hex(hash(id, i))), ' ') as text")
    name = bpe._ship(df, RANKS)

    def make():
        codec = bpe.codec(name, P.PATTERN)
        before = held(os.getpid())

        def rows(texts):
            for text in texts:
                codec.encode(text)
                yield os.getpid(), before, held(os.getpid())

        return rows

    new = T.StructType([T.StructField("pid", T.LongType()), T.StructField("before", T.DoubleType()), T.StructField("during", T.DoubleType())])
    rows = add_columns(df, ["text"], new, make).collect()
    grown = max(r.during for r in rows) - rows[0].before
    kept = held(rows[0].pid) - rows[0].before
    assert kept < max(20, grown / 4)
