"""URL rules as wildcard patterns, all simulated at once by a bit-parallel automaton.

A rule is `host/path-prefix`; it fits the host and its subdomains. It becomes the glob
`*.host` + `path*` over the canonical URL `.` + host + path. Its `*` before the host stays within
the host (it does not pass `/`), the last one takes anything; rules may hold further `*` and `?`.
All globs are laid side by side into one row of bits, as many 64-bit words as needed: one bit per
state, state i of a rule meaning that i of its symbols are matched. Reading a byte shifts every
state at once (Shift-And), stars are states that also keep themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import LOWER, UPPER, utf8

#: A rule and what it says about a URL.
Rule = tuple[str, str]


@dataclass(frozen=True)
class Automaton:
    step: np.ndarray  # 256 x words: states that a byte may enter from the state before
    stay: np.ndarray  # 256 x words: states that keep themselves on a byte
    start: np.ndarray  # words
    final: tuple[tuple[int, int], ...]  # (word, bit) of each rule's last state

    def run(self, urls: Sequence[bytes]) -> np.ndarray:
        """urls x rules: which rules fit. One step per byte position, for all URLs that are as long."""
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-lengths, kind="stable")
        text = np.frombuffer(b"".join(urls), np.uint8)
        at = (np.cumsum(lengths) - lengths)[order]
        alive = len(urls) - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max(initial=0))), "right")
        state = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for position, n in enumerate(alive.tolist()):
            byte, now = text[at[:n] + position], state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.step[byte]) | (now & self.stay[byte])
        out = np.empty((len(urls), len(self.final)), bool)
        for i, (word, bit) in enumerate(self.final):
            out[order, i] = (state[:, word] >> np.uint64(bit)) & one == one
        return out


def build(rules: Sequence[str]) -> Automaton:
    """The automaton of `host/path` rules; the host part is matched in lower case."""
    every, no_slash = np.ones(256, bool), np.ones(256, bool)
    no_slash[ord("/")] = False
    states: list[tuple[np.ndarray, np.ndarray]] = []  # what enters a state, what keeps it
    starts, finals = [], []
    for rule in rules:
        host, slash, path = rule.partition("/")
        starts.append(len(states))
        states.append((~every, no_slash.copy()))
        for i, symbol in enumerate(utf8("." + host.translate(str.maketrans(UPPER, LOWER)) + slash + path + "*")):
            wild = no_slash if i <= len(utf8(host)) else every
            if symbol == ord("*"):
                states[-1] = (states[-1][0], states[-1][1] | wild)
            else:
                one = np.arange(256) == symbol
                states.append((wild.copy() if symbol == ord("?") else one, ~every))
        finals.append(len(states) - 1)
    words = max(1, -(-len(states) // 64))
    step, stay, start = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64)
    for i, (enters, keeps) in enumerate(states):
        bit = np.uint64(1) << np.uint64(i % 64)
        step[enters, i // 64] |= bit
        stay[keeps, i // 64] |= bit
    for i in starts:
        start[i // 64] |= np.uint64(1) << np.uint64(i % 64)
    return Automaton(step, stay, start, tuple((i // 64, i % 64) for i in finals))


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; both empty for null and for text without `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end].translate(str.maketrans(UPPER, LOWER)), rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host, tail[:stop]


def judge(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow",
) -> DataFrame:
    """(id, host, path, rule, verdict) per row: the longest rule that fits, else `default`.

    Of rules of one length the first given wins. Null, empty and malformed URLs have empty host
    and path and get the default. Rows are neither dropped nor merged; no shuffle.
    """
    ranked = sorted(rules, key=lambda r: -len(r[0]))
    names, verdicts = np.array([r for r, _ in ranked] + [None], object), np.array([v for _, v in ranked] + [default], object)
    automaton = build([r for r, _ in ranked])
    kind = dict(pages.select(F.col(id_col).alias("id")).dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            split = [parts(u) for u in pdf["url"]]
            fits = automaton.run([utf8("." + h + p) if h or p else b"" for h, p in split])
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), len(ranked)) if len(ranked) else np.zeros(len(split), int)
            yield pd.DataFrame({
                "id": pdf["id"], "host": [h for h, _ in split], "path": [p for _, p in split],
                "rule": names[best], "verdict": verdicts[best],
            })

    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInPandas(
        run, f"id {kind}, host string, path string, rule string, verdict string")
