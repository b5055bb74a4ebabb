"""Periodic runs of words, by online dyadic square catching.

A stretch of words in which words `q` apart are equal has period q. Such a stretch of at least
max(least, 2q) words holds, before its last q words, a whole block of 2^k words that starts at a
multiple of 2^k, for the largest 2^k with 2^(k+1) - 1 <= max(least - q, q). So every completed block is
watched by a catcher for the few periods of its size: as words are appended, the catcher compares the
block with the words that end the text now. A hit is extended to both sides by comparing suffixes, stays
open while appended words keep the period, and is reported as a run when one breaks it. A later
block of the same stretch falls into the run that is already known.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import utf8

LEAST = 12
#: Words appended at a time; a longer text takes several steps of the same state.
STEP = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 12, 1 << n.bit_length())
        _POWERS[:] = [np.cumprod(np.array([1] + [base] * size, np.uint64)) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _levels(least: int, longest: int) -> list[tuple[int, int, int]]:
    """(block, first period, last period), by rising block: the periods that blocks of a size watch for."""
    out: list[tuple[int, int, int]] = []
    q = 1
    while q <= longest:
        block = 1 << ((max(least - q, q) + 1) // 2).bit_length() - 1
        last = q if q < least else 4 * block - 2
        if out and out[-1][0] == block and out[-1][2] == q - 1:
            out[-1] = (block, out[-1][1], last)
        else:
            out.append((block, q, last))
        q = last + 1
    return sorted((b, lo, min(hi, longest)) for b, lo, hi in out)


def _primitive(word: np.ndarray, q: int) -> bool:
    """Whether no proper divisor of q is a period of `word`, 2q symbols of period q."""
    rest, r = q, 2
    while rest > 1:
        if rest % r and r * r <= rest:
            r += 1
            continue
        r = r if rest % r == 0 else rest
        if np.array_equal(word[:q], word[q // r:q // r + q]):
            return False
        while rest % r == 0:
            rest //= r
    return True


def _inside(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether [start, end) lies in one of the spans.

    Where a block and its copy q words on lie in a run of a period up to the block, q is a multiple of
    that period, and the stretch of period q is that run.
    """
    if not spans:
        return np.zeros(len(starts), bool)
    begins, stops = np.array(sorted(spans)).T
    at = np.searchsorted(begins, starts, side="right") - 1
    return (at >= 0) & (np.maximum.accumulate(stops)[np.maximum(at, 0)] >= ends)


class SquareCatcher:
    """Words go in by `append`; every run (start, length, period) comes out once, when its end is known.

    The state is the words, their prefix hashes and the open stretches, one per period at most. The cost
    of an appended word is a few comparisons per block size. Hashes only choose: every stretch is compared
    word by word. Who knows the number of words to come names half of it as `longest` period.
    """

    def __init__(self, least: int = LEAST, longest: int | None = None) -> None:
        self.least, self.longest, self.n = least, longest, 0
        self.words, self.sums = np.zeros(64, np.int64), np.zeros(65, np.uint64)
        self.open: dict[int, int] = {}

    def _back(self, end: int, q: int) -> int:
        """How many words before `end` equal, without a gap, the word q before them."""
        at, step = end, 32
        while at > q:
            low = max(q, at - step)
            differ = np.flatnonzero(self.words[low:at] != self.words[low - q:at - q])
            if len(differ):
                return end - (low + int(differ[-1]) + 1)
            at, step = low, 2 * step
        return end - at

    def _forth(self, at: int, q: int) -> int:
        """Where, from `at` on, the first word differs from the word q before it; n if none does."""
        step = 32
        while at < self.n:
            high = min(self.n, at + step)
            differ = np.flatnonzero(self.words[at:high] != self.words[at - q:high - q])
            if len(differ):
                return at + int(differ[0])
            at, step = high, 2 * step
        return at

    def _is_run(self, start: int, end: int, q: int) -> bool:
        return end - start >= max(self.least, 2 * q) and _primitive(self.words[start:start + 2 * q], q)

    def _grow(self, new: np.ndarray) -> None:
        n = self.n + len(new)
        if n > len(self.words):
            self.words = np.concatenate([self.words[:self.n], np.zeros(2 * n - self.n, np.int64)])
            self.sums = np.concatenate([self.sums[:self.n + 1], np.zeros(2 * n - self.n, np.uint64)])
        self.words[self.n:n] = new
        mixed = (new.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.sums[self.n + 1:n + 1] = self.sums[self.n] + np.cumsum(mixed * _powers(n)[0][self.n:n], dtype=np.uint64)
        self.n = n

    def _hits(self, block: int, low: int, high: int, since: int) -> tuple[np.ndarray, np.ndarray]:
        """(block starts, periods) of blocks that recur at a watched period in words that end after `since`."""
        first = max(since + 1, block + low)
        if first > self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.arange(first, self.n + 1)
        sums, inverse = self.sums, _powers(self.n)[1]
        here = (sums[ends] - sums[ends - block]) * inverse[ends - block]
        aligned = np.arange(0, self.n - block + 1, block)
        blocks = (sums[aligned + block] - sums[aligned]) * inverse[aligned]
        nearest = (ends - block - low) // block
        starts, periods = [], []
        for back in range((high - low) // block + 1):
            number = nearest - back
            found = np.flatnonzero(blocks[number] == here) if back == 0 else np.flatnonzero((blocks[np.maximum(number, 0)] == here) & (number >= 0))
            x = number[found] * block
            q = ends[found] - block - x
            fits = q <= high
            starts.append(x[fits])
            periods.append(q[fits])
        return np.concatenate(starts), np.concatenate(periods)

    def append(self, new: np.ndarray) -> list[tuple[int, int, int]]:
        since = self.n
        self._grow(new)
        closed: list[tuple[int, int, int]] = []
        known: dict[int, list[tuple[int, int]]] = {}  # period: stretches that reach into the new words
        covers: list[tuple[int, int, int]] = []  # (period, start, end) of the runs among them
        held, self.open = self.open, {}

        def settle(start: int, end: int, q: int) -> None:
            known.setdefault(q, []).append((start, end))
            run = self._is_run(start, end, q)
            if run:
                covers.append((q, start, end))
            if end == self.n:
                self.open[q] = start
            elif run:
                closed.append((start, end - start, q))

        for q, start in held.items():
            settle(start, self._forth(since, q), q)
        for block, low, high in _levels(self.least, min(self.n, self.longest or self.n)):
            x, q = self._hits(block, low, high, since)
            by = np.lexsort((x, q))
            x, q = x[by], q[by]
            while len(x):
                outside = ~_inside(x, x + q + block, [(s, e) for p, s, e in covers if p <= block])
                x, q = x[outside], q[outside]
                # a run of a period up to the block may cover hits of the periods above it
                now = np.searchsorted(q, q[0], side="right") if len(q) and q[0] <= block else len(q)
                for x_, q_ in zip(x[:now].tolist(), q[:now].tolist()):
                    end = x_ + q_ + block
                    if any(s <= x_ and end <= e for s, e in known.get(q_, ())[-2:]):
                        continue
                    same = self._back(end, q_)
                    if same >= block:
                        settle(end - same - q_, self._forth(end, q_), q_)
                x, q = x[now:], q[now:]
        return closed

    def finish(self) -> list[tuple[int, int, int]]:
        """The runs that reach the end of the words."""
        return [(s, self.n - s, q) for q, s in self.open.items() if self._is_run(s, self.n, q)]


def runs_of(symbols: np.ndarray, least: int = LEAST, step: int = STEP) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text, by start, then period."""
    if len(symbols) < least:
        return []
    catcher, out = SquareCatcher(least, len(symbols) // 2), []
    for at in range(0, len(symbols), step):
        out += catcher.append(symbols[at:at + step])
    return sorted((out + catcher.finish()), key=lambda r: (r[0], r[2]))


def _collapse(text: str | None, least: int) -> tuple[int, list[int], list[int], list[int], str]:
    words = utf8(text).split()
    size, number = len(words), {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = runs_of(np.fromiter(map(number.__getitem__, words), np.int64, size), least)
    starts, lengths, periods = map(list, zip(*runs)) if runs else ([], [], [])
    if runs:
        edges = np.zeros(size + 1, np.int64)
        np.add.at(edges, np.array(starts) + np.array(periods), 1)
        np.add.at(edges, np.array(starts) + np.array(lengths), -1)
        words = [w for w, drop in zip(words, (np.cumsum(edges[:-1]) > 0).tolist()) if not drop]
    return size, starts, lengths, periods, b" ".join(words).decode("utf-8", "surrogatepass")


def collapse(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) per row of `docs`.

    Words are what white space (ASCII) separates. A run is a stretch of at least max(`least`, twice its
    period) words with that smallest period, which no neighbouring word extends; `runs` lists (start,
    length, period) by start, then period. `collapsed` has the words that no run contains after its
    first period, joined by a space. Null and empty texts have
    no words, no runs and an empty `collapsed`; repeated rows and null ids are answered row by row; other
    columns are not read.
    """
    @F.pandas_udf("n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_collapse(t, least) for t in texts], columns=["n_words", "starts", "lengths", "periods", "collapsed"])

    r = docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("r"))
    runs = F.arrays_zip(F.col("r.starts").alias("start"), F.col("r.lengths").alias("length"), F.col("r.periods").alias("period"))
    return r.select("id", "r.n_words", runs.alias("runs"), "r.collapsed")


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones the first to start, then the smallest period."""
    key = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.struct((-key["start"]).alias("start"), key["length"].alias("length"), (-key["period"]).alias("period"))
