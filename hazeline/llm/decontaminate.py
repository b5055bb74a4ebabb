"""Benchmark passages in documents, by winnowed fingerprints and extension of hits.

Every item gives windows of `window` words (a shorter item is one window of its own length m).
For windows of m words, texts are fingerprinted with k-grams of k = min(4, m) words, keeping the
smallest hash of every m - k + 1 consecutive grams. Equal windows keep the same gram, so every
shared window has a fingerprint in common. A common fingerprint is extended to the windows that keep
it: each is looked up among the item windows by its hash and compared word by word, and neighbouring
windows grow together to spans. Windows repeated in an item are held once and in a document compared
once, so the cost is linear in both, repeated words included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import LOWER_BYTES, utf8
from hazeline.session import durable

GRAM = 4
#: Everything that is no ASCII letter or digit and no byte of another character separates words.
_WORDS = bytes(
    LOWER_BYTES[c] if chr(c).isalnum() or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORDS).split()


def rolled(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """One hash for the `length` word numbers from each start on."""
    mixed = np.zeros(len(starts), np.uint64)
    for i in range(length):
        mixed = (mixed ^ ids[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def winnow(ids: np.ndarray, length: int) -> np.ndarray:
    """The hash of the gram that each window of `length` words keeps, by window start."""
    gram = min(GRAM, length)
    if len(ids) < length:
        return np.empty(0, np.uint64)
    grams = rolled(ids, np.arange(len(ids) - gram + 1), gram)
    return np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1).min(axis=1)


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


@dataclass
class Windows:
    """The distinct windows of one length, an entry per item: sorted hashes, item numbers and places."""

    grams: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray


@dataclass
class Items:
    """A slice of the benchmark."""

    names: list[str]
    words: list[list[bytes]]
    windows: dict[int, Windows] = field(default_factory=dict)  # by length


def read_items(rows: list[tuple], window: int) -> Items:
    items, found = Items([], []), {}
    for name, text in rows:
        words = words_of(text)
        if not words:
            continue
        length, ids = min(window, len(words)), word_ids(words)
        hashes, place = np.unique(rolled(ids, np.arange(len(words) - length + 1), length), return_index=True)
        parts = found.setdefault(length, ([], [], [], []))
        for part, values in zip(parts, (np.unique(winnow(ids, length)), hashes, np.full(len(hashes), len(items.names), np.int32), place.astype(np.int32))):
            part.append(values)
        items.names.append(name)
        items.words.append(words)
    for length, parts in found.items():
        grams, hashes, item, place = map(np.concatenate, parts)
        order = np.argsort(hashes, kind="stable")
        items.windows[length] = Windows(np.unique(grams), hashes[order], item[order], place[order])
    return items


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in the (not empty) sorted array."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def scan(words: list[bytes], items: Items) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans [from, to) of a document that hold item windows, and the items found."""
    spans, found, ids = [], set(), word_ids(words)
    for length, held in items.windows.items():
        starts = np.flatnonzero(among(winnow(ids, length), held.grams))
        hashes = rolled(ids, starts, length)
        hit = among(hashes, held.hashes)
        seen: dict[tuple[bytes, ...], bool] = {}
        for at, h in zip(starts[hit].tolist(), hashes[hit]):
            line = tuple(words[at:at + length])
            if line not in seen:
                entries = range(*(int(np.searchsorted(held.hashes, h, side)) for side in ("left", "right")))
                equal = [held.item[e] for e in entries if tuple(items.words[held.item[e]][held.place[e]:held.place[e] + length]) == line]
                found.update(items.names[i] for i in equal)
                seen[line] = bool(equal)
            if seen[line]:
                spans.append((at, at + length))
    return merged(sorted(spans)), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def slices_of(benchmark: DataFrame, slice_bytes: int, item_col: str = "item_id") -> list[DataFrame]:
    """Tables (name, text) of about `slice_bytes` of text each; rows without an id or a text have no windows."""
    text = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col("text")).where(
        "name IS NOT NULL AND text IS NOT NULL").distinct()
    size = text.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // slice_bytes))
    return [text if n == 1 else text.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == i) for i in range(n)]


def matches(part: DataFrame, text: Column, window: int = 10) -> Column:
    """struct(n_words, starts, stops, items): the word spans of `text` that hold windows of a slice's items."""
    rows = [(r["name"], r["text"]) for r in part.collect()]  # a slice is bounded
    shared = part.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf("n_words long, starts array<long>, stops array<long>, items array<string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        items = read_items(shared.value, window)
        for texts in batches:
            out = []
            for words in map(words_of, texts):
                spans, found = scan(words, items)
                out.append((len(words), [a for a, _ in spans], [b for _, b in spans], sorted(found)))
            yield pd.DataFrame(out, columns=["n_words", "starts", "stops", "items"])

    return of(text)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", slice_bytes: int = 32 << 20,
) -> DataFrame:
    """(id, n_words, starts, stops, items) per row of `docs`: word spans [start, stop) that hold item windows.

    The benchmark goes to the tasks in slices of about `slice_bytes` of text, so what is broadcast
    stays bounded; each slice scans the documents once. Null texts have no words and no spans; an
    item without words or without an id has no windows. Rows of one item count as one item. Rows of
    `docs` are kept as they are, repeated ids too.
    """
    parts = slices_of(benchmark, slice_bytes, item_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if len(parts) == 1:
        return rows.select("id", matches(parts[0], F.col("text"), window).alias("m")).select("id", "m.*")
    numbered = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    scanned = [numbered.select("row", matches(p, F.col("text"), window).alias("m")).select("row", "m.*") for p in parts]
    every = scanned[0]
    for more in scanned[1:]:
        every = every.unionByName(more)

    @F.pandas_udf("starts array<long>, stops array<long>")
    def union(starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
        spans = [merged(sorted(zip(a.tolist(), b.tolist()))) for a, b in zip(starts, stops)]
        return pd.DataFrame({"starts": [[a for a, _ in s] for s in spans], "stops": [[b for _, b in s] for s in spans]})

    joined = every.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("stops")).alias("stops"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = numbered.select("row", "id").join(joined, "row")
    return out.select("id", "n_words", union("starts", "stops").alias("u"), "items").select("id", "n_words", "u.*", "items")


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id",
    slice_bytes: int = 32 << 20,
) -> DataFrame:
    """The rows of `docs` without any item window, all columns."""
    for part in slices_of(benchmark, slice_bytes, item_col):
        docs = docs.where(F.size(matches(part, F.col(text_col), window)["starts"]) == 0)
    return docs
