"""Byte-level BPE: exact encoding by longest matches and backtracking, and decoding.

The text is cut into pieces by the tokenizer's pattern. A piece is a byte string; bytes are written as the Latin-1
characters of the same number so that one Aho-Corasick automaton finds, for every position, the longest token that
starts there. Tokens are laid one after the other: a token may follow its neighbour only if the two, written
together, are split by the merges into exactly these two (a memoised property of the pair). Where the longest token
does not fit, its next shorter prefix token is tried; where none fits, the last token is taken back and the position
is marked as a dead end. A position is marked once at most, so the work is linear in the piece. As a sequence is what
the merges give if, and only if, each adjacent pair is, the ids are those of the reference tokenizer.

``encode`` on a DataFrame: null text counts as empty and gives no ids; repeated rows are encoded each (the memo of
words makes that cheap); rows, order and other columns are kept, and columns that bear a new name are replaced.
Nothing is shuffled, memory is bounded by the batch, the memos and one document.
"""

from __future__ import annotations

import base64
import copy
import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orebook.llm.batches import Memo, add_columns

#: White space as the pattern's \s means it (Unicode White_Space); Python's own \s has four control characters more.
WHITE = "\t-\r \x85\xa0  -     　"
#: A word with its punctuation and the one space before it, or white space as the pattern cuts it. No piece of the
#: pattern reaches over the end of such a chunk, so chunks can be encoded, and remembered, one by one.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
CHUNKS_KEPT, PIECES_KEPT, PAIRS_KEPT, PAIR_BITS = 250_000, 350_000, 300_000, 24

ENCODED = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("decoded", T.BinaryType()),
])
DIGESTS = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


class Codec:
    """Encoder and decoder for one rank file (base64 token, rank) and one splitting pattern."""

    def __init__(self, rank_bytes: bytes, pattern: str):
        self.token = {}
        for line in rank_bytes.splitlines():
            if line:
                word, rank = line.split()
                self.token[int(rank)] = base64.b64decode(word)
        self.rank = {b: r for r, b in self.token.items()}
        # The pattern's \s is Unicode White_Space; spelled out, as this module's \s differs.
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]")
                                     .replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.starts = ahocorasick.Automaton()
        self.size = [len(self.token.get(r, b"")) for r in range(max(self.token) + 1)]
        self.shorter = [-1] * len(self.size)
        halves: dict[int, list[int]] = {}
        for word, rank in self.rank.items():
            parts = self._merge(word, 2) if len(word) > 1 else []
            if len(parts) < 3:  # a token its own merges never make is of no use
                halves[rank] = parts
                self.starts.add_word(word.decode("latin-1"), rank)
        for word, rank in self.rank.items():
            cut = next((word[:n] for n in range(len(word) - 1, 0, -1) if word[:n].decode("latin-1") in self.starts), None)
            if cut is not None:
                self.shorter[rank] = self.rank[cut]
        self.starts.make_automaton()
        # The half that ends (begins) a token, -1 for a single byte: one after the other they are the tokens that stand
        # at the right (left) end of it while its merges are done, each swallowed by the merge of the one before.
        self.right_half, self.left_half = (array("i", [-1]) * len(self.size) for _ in range(2))
        for token, parts in halves.items():
            if parts:
                self.left_half[token], self.right_half[token] = parts
        self._remember()
        self.table = np.frombuffer(b"".join(self.token.get(r, b"") for r in range(len(self.size))), np.uint8)
        self.sizes = np.array(self.size, np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.pack = {r: r.to_bytes(4, "little") for r in self.token}

    def _remember(self) -> None:
        self.fits = Memo(self._fits, PAIRS_KEPT)
        self.chunks = Memo(self._chunk, CHUNKS_KEPT)
        self.pieces = Memo(self._piece, PIECES_KEPT)

    def for_task(self) -> Codec:
        """The same tables with empty memos, which end with the task that uses them."""
        own = copy.copy(self)
        own._remember()
        return own

    def _merge(self, word: bytes, least: int = 1) -> list[int]:
        """The merges by definition, lowest rank first, leftmost among equals, until ``least`` parts are left."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > least:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def _fits(self, pair: int) -> bool:
        """No merge crosses the border: none of the tokens that meet there would be merged before it is swallowed.

        Among merges of one rank the leftmost is done first, so the border wins a tie against the right token's own.
        """
        rank, token, right, left = self.rank.get, self.token, self.right_half, self.left_half
        last = len(self.rank) + 1
        x, until_x = pair >> PAIR_BITS, last
        while x >= 0:
            y, until_y = pair & (1 << PAIR_BITS) - 1, last
            while y >= 0:
                m = rank(token[x] + token[y])
                if m is not None and m < until_x and m <= until_y:
                    return False
                y, until_y = left[y], y
            x, until_x = right[x], x
        return True

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.rank.get(data)
        if whole is not None and data.decode("latin-1") in self.starts:
            return self.pack[whole]
        size, shorter, known = self.size, self.shorter, self.fits.get
        n = len(data)
        longest = [-1] * n
        for end, rank in self.starts.iter(data.decode("latin-1")):
            longest[end + 1 - size[rank]] = rank  # ends only grow, so the last one stays
        dead = bytearray(n + 1)
        laid: list[int] = []
        at, trial, last = 0, longest[0], -1
        while True:
            while trial >= 0:
                end = at + size[trial]
                if not dead[end]:
                    if last < 0:
                        break
                    pair = last << PAIR_BITS | trial
                    good = known(pair)
                    if good is None:
                        good = self.fits[pair]
                    if good:
                        break
                trial = shorter[trial]
            if trial >= 0:
                laid.append(trial)
                if end == n:
                    return b"".join(map(self.pack.__getitem__, laid))
                at, last, trial = end, trial, longest[end]
            elif last < 0:
                raise ValueError("the rank file cannot spell every byte")
            else:  # the last token would end at a dead place again, so its shorter prefixes are tried
                dead[at] = 1
                trial = laid.pop()
                at -= size[trial]
                last = laid[-1] if laid else -1

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))
        self.chunks.trim(), self.pieces.trim(), self.fits.trim()
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, "<u4")
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.offsets[tokens] - (ends - sizes), sizes)  # from a place in the text to one in the table
        return self.table[np.arange(len(shift)) + shift].tobytes()


_CODECS: dict[tuple, Codec] = {}


def codec(name: str, pattern: str) -> Codec:
    """The codec of a shipped rank file; its tables are built once per Python worker."""
    if (name, pattern) not in _CODECS:
        with open(SparkFiles.get(name), "rb") as f:
            _CODECS[name, pattern] = Codec(f.read(), pattern)
    return _CODECS[name, pattern].for_task()


def _ship(df: DataFrame, path: str) -> str:
    """Send the rank file to all executors (one small file, whatever the data); the name it has there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids`` (packed little-endian unsigned 32-bit) and ``decoded`` (bytes of the ids)."""
    name = _ship(df, path)

    def make():
        c = codec(name, pattern)

        def rows(texts):
            for t in texts:
                ids = c.encode(t or "")
                yield len(ids) // 4, ids, c.decode(ids)

        return rows

    return add_columns(df, [text], ENCODED, make)


def encode_digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """As ``encode``, with lowercase hex SHA-256 of ids and decoded bytes in place of the bytes themselves."""
    name = _ship(df, path)

    def make():
        c = codec(name, pattern)

        def rows(texts):
            for t in texts:
                ids = c.encode(t or "")
                yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

        return rows

    return add_columns(df, [text], DIGESTS, make)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``df`` with the text of packed ids in ``into``; null ids give null, broken UTF-8 gives replacement marks."""
    name = _ship(df, path)

    def make():
        c = codec(name, ".")

        def rows(values):
            for v in values:
                yield (None if v is None else c.decode(v).decode("utf-8", "replace"),)

        return rows

    return add_columns(df, [ids], T.StructType([T.StructField(into, T.StringType())]), make)
