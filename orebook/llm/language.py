"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language is turned into a suffix automaton. A text is parsed into the longest
phrases that occur in that sample: the automaton is followed letter by letter, and where it has no way on, a phrase
ends and the next begins. A text needs few, long phrases in its own language. The phrases per letter, times the
log of the sample's length, estimate the cross entropy; the language with the least wins.

Letters of any script, and marks, are folded to lower case, everything else to one separator; a letter that a sample
lacks has no way in its automaton and is a phrase of its own. Texts are parsed whole: they are laid out in segments of
``SEGMENT`` letters (one more phrase each, for all languages alike), and all segments of a batch walk through the
automata side by side. The ways of all automata are one hash table, so its size follows the samples and not the number
of letters of a script; the driver builds it (the samples are bounded) and tasks share it as a broadcast.

Learned are the ``LANGUAGES`` languages with most distinct texts; of each up to ``SAMPLE_TEXTS`` distinct texts, drawn by
hash, give a slice of equal length from a place that the hash tells, ``SAMPLE_LETTERS`` together, less where more than
20 languages share ``TOTAL_LETTERS``. So no text and no order of rows decides the sample, and copies count once.

Text that is null or has no letter (marks, digits and signs are none) is ``und`` with score 0. A language without usable
labelled text is not learned; without any, everything is ``und``. Ties go to the first language in alphabetical order.
Rows, order and other columns are kept, columns that bear a new name are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import math
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebook.llm.batches import add_columns

#: Bounds of what is learned: letters and texts per language, letters of all languages, and languages.
SAMPLE_LETTERS, TOTAL_LETTERS, SAMPLE_TEXTS, LANGUAGES = 60_000, 1_200_000, 400, 200
SEGMENT, LANES = 1024, 4096
UNKNOWN = "und"
PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
SPACE = 32


@functools.cache
def _folded() -> np.ndarray:
    """The lower case of each letter and mark by code point; a space for all else."""
    out = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        if unicodedata.category(c := chr(i))[0] in "LM":
            out[i] = ord(c.lower()[0])
    return out


def letters(text: str | None) -> np.ndarray:
    """Code points of lower-case letters and marks; every run of anything else is one space, none at the ends."""
    folded = _folded()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    blank = folded == SPACE
    blank[1:] &= blank[:-1]
    out = folded[~blank]
    return out[int(len(out) > 0 and out[0] == SPACE): len(out) - int(len(out) > 1 and out[-1] == SPACE)]


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def has_letter(text: str | None) -> bool:
    return bool(_is_letter()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")].any())


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of ``codes``: for each state the next state by code."""
    ways: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for code in codes:
        new = len(ways)
        ways.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and code not in ways[at]:
            ways[at][code] = new
            at = link[at]
        if at >= 0:
            to = ways[at][code]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(ways)
                ways.append(dict(ways[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and ways[at].get(code) == to:
                    ways[at][code] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return ways


class Ways:
    """A hash table from non-negative 64-bit keys to numbers, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (len(self.keys) - 1)
            held = self.keys[slot]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            goes_on = ~hit & (held != -1)
            open_, slot = open_[goes_on], slot[goes_on]
        return out


class Model:
    """Automata of all languages over one alphabet: 0 is a letter that no sample has, 1 the separator, -1 the end."""

    def __init__(self, samples: dict[str, list[str]]):
        text = {}
        for lang, some in sorted(samples.items()):
            joined = [x for t in some if len(folded := letters(t)) for x in (folded, [SPACE])]
            if joined:
                text[lang] = np.concatenate(joined).astype(np.uint32)
        self.langs = list(text)
        seen = np.unique(np.concatenate([*text.values(), np.empty(0, np.uint32)]))
        seen = seen[seen != SPACE]
        self.width = len(seen) + 2
        self.code = np.zeros(0x110000, np.int32)
        self.code[seen] = np.arange(2, self.width)
        self.code[SPACE] = 1
        self.scale = np.array([math.log2(len(t) + 2) for t in text.values()])
        # States of all automata are numbered through, so that all languages walk in one table.
        keys, values, bases, used = [], [], [], 0
        self.start = np.empty((len(text), self.width), np.int32)
        for row, t in zip(self.start, text.values()):
            ways = automaton(self.code[t].tolist())
            row[:] = used
            row[list(ways[0])] = np.array(list(ways[0].values()), np.int32) + used
            keys.append(np.fromiter((c for w in ways for c in w), np.int64)
                        + np.repeat(np.arange(used, used + len(ways)), [len(w) for w in ways]) * self.width)
            values.append(np.fromiter((to + used for w in ways for to in w.values()), np.int32))
            bases.append(used)
            used += len(ways)
        self.base = np.array(bases, np.int64)
        self.ways = Ways(np.concatenate([*keys, np.empty(0, np.int64)]), np.concatenate([*values, np.empty(0, np.int32)]))

    def phrases(self, codes: np.ndarray) -> np.ndarray:
        """``codes``: letters by segment (position first, -1 after the end); phrase ends by language and segment."""
        lanes = codes.shape[1]
        state = np.repeat(self.base, lanes).reshape(len(self.base), lanes)
        ends = np.zeros(state.shape, np.int32)
        for row in codes:
            lanes = int(np.count_nonzero(row >= 0))  # fuller segments come first
            row = row[:lanes]
            to = self.ways.find((state[:, :lanes] * self.width + row).ravel()).reshape(-1, lanes)
            lost = to < 0
            ends[:, :lanes] += lost
            state[:, :lanes] = np.where(lost, self.start[:, row], to)
        return ends

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        clean = [self.code[letters(t)] if has_letter(t) else () for t in texts]
        sizes = [len(t) for t in clean]
        parts = [-(-n // SEGMENT) for n in sizes]
        owner = np.repeat(np.arange(len(texts)), parts)
        total = np.zeros((len(self.langs), len(texts)))
        if len(owner) and self.langs:
            first = np.cumsum([0, *parts])
            flat = np.full((len(owner), SEGMENT), -1, np.int32)
            for i, t in enumerate(clean):
                if sizes[i]:
                    flat[first[i]:first[i + 1]].reshape(-1)[: len(t)] = t
            fill = (flat >= 0).sum(axis=1)
            by_fill = np.argsort(-fill, kind="stable")
            for at in range(0, len(by_fill), LANES):
                some = by_fill[at:at + LANES]
                ends = self.phrases(np.ascontiguousarray(flat[some, : fill[some[0]]].T)) + 1
                for k in range(len(self.langs)):
                    total[k] += np.bincount(owner[some], ends[k], len(texts))
        out = []
        for i, n in enumerate(sizes):
            if not n or not self.langs:
                out.append((UNKNOWN, 0.0))
                continue
            entropy = total[:, i] * self.scale / n
            best = int(entropy.argmin())
            rest = np.delete(entropy, best)
            out.append((self.langs[best], float(1 - entropy[best] / rest.min()) if len(rest) else 1.0))
        return out


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """Slices of at most ``SAMPLE_TEXTS`` distinct texts per language, drawn by their hash; the driver gets only these."""
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where(
        "lang is not null and text rlike '[\\\\p{L}]'")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    counts = hashed.groupBy("lang").agg(F.count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return {}
    letters_each = min(SAMPLE_LETTERS, TOTAL_LETTERS // len(counts))
    bounds = labelled.sparkSession.createDataFrame(
        [(r.lang, min(1.0, 2.0 * SAMPLE_TEXTS / r.n), letters_each // min(SAMPLE_TEXTS, r.n)) for r in counts],
        "lang string, share double, size int")
    # At most LANGUAGES rows. About twice as many texts as needed are drawn before copies go and the first by hash stay.
    drawn = (hashed.join(F.broadcast(bounds), "lang").where("pmod(h, 1000000) < share * 1000000")
             .withColumn("piece", F.expr("substring(text, cast(1 + pmod(h, greatest(1, length(text) - size + 1)) as int), size)")))
    order = Window.partitionBy("lang").orderBy("h")
    chosen = drawn.select("lang", "h", "piece").dropDuplicates(["lang", "h"]).withColumn("n", F.row_number().over(order))
    samples: dict[str, list[str]] = {}
    for r in chosen.where(F.col("n") <= SAMPLE_TEXTS).orderBy("lang", "n").collect():
        samples.setdefault(r.lang, []).append(r.piece)
    return samples


def identify(df: DataFrame, labelled: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``: 0 where two languages explain the text alike, towards 1 where one does."""
    sent = df.sparkSession.sparkContext.broadcast(Model(learn(labelled)))
    return add_columns(df, [text], PREDICTED, lambda: sent.value.predict)
