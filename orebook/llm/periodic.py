"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q, at least ``REPEATS`` periods and ``LEAST`` words long, that no
neighbouring word extends. A run with q in [s, 2s), s a power of two, holds a block of s words that starts at a multiple
of s among the first s words of the run, and that block comes again q words later. So at every dyadic scale s each block
is held against the window of words that follows at distances s to 2s: the sums of squared differences of word numbers
at all distances are one convolution, worked out exactly by number-theoretic transforms, and where a sum is zero the
block occurs. These distances are seeds; a seed is extended word by word to both sides, which gives the run.

Sums are exact: they are known modulo as many primes as their bound needs. Blocks that cannot occur are not transformed:
those of which a short word sequence does not recur at any distance from s to 2s, and those inside a run found at a
smaller scale (they only find its multiples again). Of blocks longer than ``HEAD`` words the head is transformed and
the extension compares the rest, so memory does not follow the length of a text. Several texts are laid end to end with
a number of its own between any two, so that short texts share the transforms.

Words are maximal runs of anything but ASCII white space. Null and empty texts have no words, no runs and an empty
collapsed text; very long texts are read whole; repeated rows get equal results; an empty table gives an empty one.
Rows, their order and other columns are kept, columns that bear a new name are replaced.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orebook.llm.batches import add_columns

REPEATS, LEAST = 4, 6
#: Words of a block that are transformed; words of texts handled together; numbers transformed together.
HEAD, WORDS_AT_ONCE, NUMBERS_AT_ONCE = 2**15, 200_000, 2**19
#: Primes p with p - 1 divisible by 2**25 and a non-residue of each, whose powers give roots of unity.
PRIMES = ((2013265921, 31), (1811939329, 13), (2113929217, 5))
PROBES = 8
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))),
    T.StructField("collapsed", T.StringType()),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _powers(root: int, count: int, prime: int) -> np.ndarray:
    """root ** 0, 1, ... modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < count:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), prime)) % np.uint64(prime)])
    return out[:count]


def transform(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Number-theoretic transform of each row; the length is a power of two, ``root`` a primitive root of unity of it."""
    count, size = rows.shape
    p, out, step = np.uint64(prime), rows.reshape(count, size, 1), root
    while size > 1:
        half = size // 2
        low, high = out[:, :half], out[:, half:]
        new = np.empty((count, half, 2, out.shape[2]), np.uint64)
        np.remainder(low + high, p, out=new[:, :, 0])
        np.remainder((low + (p - high)) * _powers(step, half, prime)[None, :, None] % p, p, out=new[:, :, 1])
        out, size, step = new.reshape(count, half, -1), half, step * step % prime
    return out.reshape(count, -1)


def zero_distances(block: np.ndarray, window: np.ndarray, top: int) -> np.ndarray:
    """For rows of ``block`` (c words) and ``window`` (2c - 1 words): at which of the c places the block occurs.

    Words are numbers up to ``top``; a place is an occurrence where the sum of squared differences is zero.
    """
    rows, c = block.shape
    size, zero, bound = 2 * c, np.ones((rows, c), bool), c * top * top
    for prime, generator in PRIMES:
        p, root = np.uint64(prime), pow(generator, (prime - 1) // size, prime)
        b, t = block.astype(np.uint64) % p, window.astype(np.uint64) % p
        turned, padded = np.zeros((rows, size), np.uint64), np.zeros((rows, size), np.uint64)
        turned[:, 0], turned[:, size - c + 1:] = b[:, 0], b[:, :0:-1]
        padded[:, :2 * c - 1] = t
        both = transform(turned, prime, root) * transform(padded, prime, root) % p
        product = transform(both, prime, pow(root, -1, prime))[:, :c] * np.uint64(pow(size, -1, prime)) % p
        squares = np.zeros((rows, size), np.uint64)
        np.cumsum(t * t % p, axis=1, out=squares[:, 1:])
        sums = (b * b % p).sum(axis=1, dtype=np.uint64)[:, None] + squares[:, c:] - squares[:, :c]
        zero &= sums % p == product * np.uint64(2) % p
        bound //= prime
        if not bound:
            return zero
    return zero  # further false zeros would only be seeds that the extension turns down


class _Recurrence:
    """Tells whether the sequence of ``size`` words at a place comes again at a distance from s to 2s."""

    def __init__(self, words: np.ndarray, size: int):
        mixed = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - size + 1 + i].astype(np.uint64)
        order = np.argsort(mixed, kind="stable")
        in_order = mixed[order]
        number = np.cumsum(np.concatenate([[0], in_order[1:] != in_order[:-1]])) * len(words)
        self.size, self.count = size, len(words)
        self.keys = number + order
        self.base = np.empty(len(order), np.int64)
        self.base[order] = number

    def __call__(self, at: np.ndarray, s: int) -> np.ndarray:
        first = np.searchsorted(self.keys, self.base[at] + np.minimum(at + s, self.count))
        found = self.keys[np.minimum(first, len(self.keys) - 1)]
        return (first < len(self.keys)) & (found < self.base[at] + np.minimum(at + 2 * s, self.count))


def _reach(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on, to the right (step 1) or left (step -1), equal the one a period later."""
    count, some = 0, 64
    while True:
        if step > 0:
            low, high = at + count, min(at + count + some, len(words) - period)
        else:
            low, high = max(0, at - count - some + 1), at - count + 1
        if high <= low:
            return count
        unequal = words[low:high] != words[low + period:high + period]
        if unequal.any():
            return count + int(unequal.argmax() if step > 0 else unequal[::-1].argmax())
        count, some = count + high - low, min(2 * some, 2**20)


def _seeds(words: np.ndarray, starts: np.ndarray, s: int):
    """Pairs (block start, distance) of the blocks' zero-mismatch occurrences, in the order of starts."""
    c = min(s, HEAD)
    top = int(words.max()) + 1
    padded = np.concatenate([words, np.full(3 * s, top)])
    at_once = max(1, NUMBERS_AT_ONCE // (2 * c))
    first = np.repeat(starts, s // c)
    shift = np.tile(np.arange(s, 2 * s, c), len(starts))
    for low in range(0, len(first), at_once):
        a, d = first[low:low + at_once], shift[low:low + at_once]
        zero = zero_distances(padded[a[:, None] + np.arange(c)], padded[(a + d)[:, None] + np.arange(2 * c - 1)], top)
        row, place = np.nonzero(zero)
        yield a[row], d[row] + place


def runs_of(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period. ``longest``: no run is longer."""
    count, out, done = len(words), {}, {}
    longest = min(count, longest or count)
    recurs: _Recurrence | None = None
    s = 1
    while REPEATS * s <= longest:
        if recurs is None or recurs.size < min(s, 4):
            recurs = _Recurrence(words, min(s, 4))
        starts = np.arange(0, count - 3 * s + 1, s)
        inside = np.zeros(len(starts), bool)
        for start, end in {(a, b) for a, b in out}:
            inside[-(-start // s):max(0, (end - 3 * s) // s + 1)] = True
        starts = starts[~inside]
        for offset in np.unique(np.linspace(0, s - recurs.size, PROBES).astype(int)):
            starts = starts[recurs(starts + offset, s)]
        for a, d in _seeds(words, starts, s):
            # In a run the words from the block on agree with those a period later for two periods at least.
            fits = a + 3 * d <= count
            a, d = a[fits], d[fits]
            for i in range(min(2 * s, 32)):
                same = words[a + i] == words[a + i + d]
                a, d = a[same], d[same]
            for start, period in zip(a.tolist(), d.tolist()):
                if start < done.get(period, 0):
                    continue
                right = start + _reach(words, start, period, 1)
                if right < start + 2 * period:
                    continue
                done[period] = right
                left = start - (_reach(words, start - 1, period, -1) if start else 0)
                end = right + period
                if end - left >= max(LEAST, REPEATS * period):
                    out[left, end] = min(period, out.get((left, end), period))
        s *= 2
    return sorted((left, end - left, period) for (left, end), period in out.items())


def find_in_texts(texts: list[str | None]):
    """Number of words, runs and collapsed text of each text; texts are handled ``WORDS_AT_ONCE`` words at a time."""
    held: list[list[bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        held.append(words_of(text))
        size += len(held[-1])
        if size >= WORDS_AT_ONCE or i == len(texts) - 1:
            yield from _together(held)
            held, size = [], 0


def _together(texts: list[list[bytes]]):
    number: defaultdict = defaultdict(itertools.count().__next__)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(np.concatenate([[0], sizes + 1]))
    words = np.empty(begin[-1], np.int64)
    for i, t in enumerate(texts):
        words[begin[i]:begin[i] + sizes[i]] = np.fromiter(map(number.__getitem__, t), np.int64, len(t))
    words[begin[1:] - 1] = len(number) + np.arange(len(texts))  # a number of its own after each text
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs_of(words, int(sizes.max(initial=0))):
        i = int(np.searchsorted(begin, start, side="right")) - 1
        found[i].append((start - int(begin[i]), length, period))
    for t, runs in zip(texts, found):
        if runs:
            change = np.zeros(len(t) + 1, np.int64)
            for start, length, period in runs:
                change[start + period] += 1
                change[start + length] -= 1
            t, n = [t[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()], len(t)
        else:
            n = len(t)
        yield n, [dict(start=a, length=b, period=q) for a, b, q in runs], b" ".join(t).decode("utf-8", "surrogatepass")


def find_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``runs`` (structs start, length, period, by start and period) and ``collapsed`` (the text
    without the words that repeat the first period of a run, joined by single spaces)."""
    return add_columns(df, [text], FOUND, lambda: find_in_texts)
