"""Quality rules on repetition inside a text, by suffix array and longest-common-prefix intervals.

The texts of a group are laid end to end as word numbers that differ from text to text, so one suffix
array serves them all and no match leaves its text. Suffixes are sorted by prefix doubling (only ties
are sorted again); the ranks of each doubling answer longest common prefixes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import utf8

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Bytes of text whose suffixes are sorted together; a longer text is a group of its own.
GROUP = 1 << 20
#: Production limits: repeats of at least so many words count; in percent of the words; in words.
MIN_WORDS, MAX_COVERED, MAX_LONGEST = 10, 45, 100


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, lcp): sorted suffixes, and lcp[i] = common prefix of the suffixes at i - 1 and i (lcp[0] = 0)."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a rank is 1 + the number of suffixes that sort before all of its ties; 0 stands behind the end
    order = np.argsort(symbols, kind="stable")
    rank = np.zeros(n + 1, np.int32)
    _rank_sorted(rank, order, symbols[order], np.ones(n, np.int64), np.zeros(n, np.int64))
    levels, width = [rank], 1
    tied = _tied(rank, order)
    while len(tied):
        key = rank[tied].astype(np.int64) * (n + 1) + rank[np.minimum(tied + width, n)]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        base = rank[tied]
        starts = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
        group = np.repeat(starts, np.diff(np.append(starts, len(tied))))
        rank = rank.copy()
        _rank_sorted(rank, tied, key, base, group)
        levels.append(rank)
        width *= 2
        tied = _tied(rank, tied)
    sa = np.empty(n, np.int64)
    sa[rank[:n] - 1] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    pair = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b, length = sa[pair - 1], sa[pair], np.zeros(len(pair), np.int64)
    for at in range(len(levels) - 1, -1, -1):
        same = levels[at][np.minimum(a + length, n)] == levels[at][np.minimum(b + length, n)]
        length += same.astype(np.int64) << at
    lcp[pair] = length
    return sa, lcp


def _rank_sorted(rank: np.ndarray, order: np.ndarray, key: np.ndarray, base: np.ndarray, group: np.ndarray) -> None:
    """Ranks of sorted positions: the group's rank plus the place of the first equal key in the group."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    first = np.repeat(starts, np.diff(np.append(starts, len(key))))
    rank[order] = base + first - group


def _tied(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of positions sorted by rank those that share it with a neighbour."""
    r = rank[order]
    same = r[1:] == r[:-1]
    return order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]


def maximal_repeats(symbols: np.ndarray, sa: np.ndarray, lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the maximal repeats of at least `least` symbols: suffixes sa[first..last] share them.

    These are the intervals of equal common prefix that cannot be extended to the right (by being such
    an interval) nor to the left (their suffixes have different symbols before them).
    """
    before = np.where(sa > 0, symbols[np.maximum(sa, 1) - 1], -1)
    change = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))
    high = np.flatnonzero(lcp >= least)
    for run in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1) if len(high) else []:
        stack: list[tuple[int, int]] = []  # (length, first), lengths rising
        for i, length in zip(range(run[0], run[-1] + 2), [*lcp[run].tolist(), 0]):
            first = i - 1
            while stack and stack[-1][0] > length:
                held, first = stack.pop()
                if change[i - 1] > change[first]:
                    yield held, first, i - 1
            if length >= least and (not stack or stack[-1][0] < length):
                stack.append((length, first))


def covered(sa: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Whether a position lies in a repeat of at least `least` symbols.

    A suffix is covered as far as its longest interval reaches. Where that interval is not maximal, the
    repeat that extends it to the left reaches as far, so the union is that of the maximal repeats.
    """
    n = len(sa)
    longest = np.maximum(lcp, np.append(lcp[1:], 0))
    reach = np.zeros(n, np.int64)
    reach[sa] = np.where(longest >= least, sa + longest, 0)
    return np.maximum.accumulate(reach) > np.arange(n) if n else reach.astype(bool)


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif utf8(line).split():
            seen.add(line)
    return again


def _group_rows(texts: list[str], least: int) -> Iterator[tuple]:
    words = [utf8(t).split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [w for part in words for w in part]
    number, _ = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), None)
    owner = np.repeat(np.arange(len(texts)), sizes)
    symbols = owner * (len(flat) + 1) + number
    sa, lcp = suffix_array(symbols)
    three, long = covered(sa, lcp, 3), covered(sa, lcp, least)
    repeats: list[list[tuple[int, int]]] = [[] for _ in texts]
    for length, first, last in maximal_repeats(symbols, sa, lcp, least):
        repeats[owner[sa[first]]].append((length, last - first + 1))
    stops = np.cumsum(sizes)
    for i, text in enumerate(texts):
        a, b = int(stops[i] - sizes[i]), int(stops[i])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], long[a:b], [False]]).astype(np.int8)))
        chars = sum(1 for w in words[i] for c in w if c & 0xC0 != 0x80) if not text.isascii() else sum(map(len, words[i]))
        yield (b - a, chars, len(SYMBOLS.findall(text)), dup_lines(text), int(three[a:b].sum()), int(long[a:b].sum()),
               max((n for n, _ in repeats[i]), default=0), len(repeats[i]), edge[::2].tolist(), edge[1::2].tolist())


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, "
          "longest_repeat long, n_repeats long, starts array<long>, stops array<long>")


def measures(text: Column, least: int = MIN_WORDS) -> Column:
    """Struct of FIELDS per text: base counts, and the union [starts, stops) of its maximal repeats in words."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows, group, size = [], [], 0
        for t in texts:
            t = t if t is not None else ""
            if group and size + len(t) > GROUP:
                rows += _group_rows(group, least)
                group, size = [], 0
            group.append(t)
            size += len(t)
        rows += _group_rows(group, least)
        return pd.DataFrame(rows, columns=names)

    return of(text)


def judge(
    docs: DataFrame, least: int = MIN_WORDS, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, FIELDS, base_failed, kept) per row of `docs`.

    Words are what white space (ASCII) separates. The base rules reject texts of under 50 words and those
    with over half of the words in repeated 3-word windows. Of the rest a text is kept if at most
    `max_covered` percent of its words lie in repeats of `least` or more words and no repeat is longer
    than `max_longest` words; overlapping occurrences count. Null and empty texts have no words and
    fail; repeated rows and null ids are judged row by row; other columns are not read.
    """
    m = docs.select(F.col(id_col).alias("id"), measures(F.col(text_col), least).alias("m")).select("id", "m.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (100 * F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
