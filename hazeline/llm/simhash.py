"""SimHash near-duplicates, found by anchor points of a covering code.

A fingerprint has 64 bits, cut into `blocks` pieces. Two fingerprints that differ in at most
`threshold` bits agree in some `pick` of the pieces up to `slack = pick * threshold // blocks`
bits. Within such a window the anchors are the words of a covering code: a [15, 11] Hamming code
on the first 15 bits (every point is at most one bit from a code word), all points on the other
bits. Every fingerprint has one home anchor within the covering radius and is replicated to all
anchors within radius + slack; so of any linked pair, one meets the other at its home.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import LOWER_BYTES, bounded, join_small, utf8
from hazeline.llm.components import components
from hazeline.session import durable

SEED = 42
CODED = 15
PIECE = 1 << 16
COMPARED = 1 << 21


def fingerprint_of(text: str | None, shingle_words: int = 4) -> int:
    """SimHash of one text as a signed 64-bit integer; 0 for null and for texts without words.

    A bit is set where it is set in more than half of the shingle hashes, repeats included.
    """
    words = utf8(text).translate(LOWER_BYTES).split()
    if not words:
        return 0
    line, size = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, size) + 1) - 1
    starts = (np.concatenate(([-1], ends[:-1])) + 1).tolist()
    stops = ends[min(shingle_words, size) - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(stops), PIECE):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at:at + PIECE], stops[at:at + PIECE])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(stops)).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle_words: int = 4) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle_words) for t in texts], dtype="int64")

    return of(text)


def syndromes() -> np.ndarray:
    """Hamming syndrome of each 15-bit value."""
    bits = (np.arange(1 << CODED)[:, None] >> np.arange(CODED)) & 1
    return np.bitwise_xor.reduce(bits * np.arange(1, CODED + 1), axis=1).astype(np.int8)


def steps(width: int, slack: int) -> list[np.ndarray]:
    """For each syndrome, the masks that lead to all anchors within 1 + slack bits, home first."""
    coded, syn = min(CODED, width), syndromes()
    by = [[] for _ in range(CODED + 1)]
    flips = [(sum(1 << i for i in c), n) for n in range(2 + slack) for c in combinations(range(coded), n)]
    free = [(sum(1 << i for i in c), n) for n in range(2 + slack) for c in combinations(range(coded, width), n)]
    for a, n in flips:
        for b, m in free:
            if n + m <= 1 + slack:
                by[syn[a]].append(((m, n), a | b))
    return [np.array([mask for _, mask in sorted(x)], np.int64) for x in by]


def windows(blocks: int, pick: int) -> list[list[tuple[int, int]]]:
    """Each choice of `pick` pieces, as (lowest bit, width) of its pieces."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    pieces = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return [list(c) for c in combinations(pieces, pick)]


def code(threshold: int, blocks: int, pick: int) -> list[tuple[list[tuple[int, int]], list[np.ndarray]]]:
    """Each window with its masks by syndrome."""
    out = []
    for parts in windows(blocks, pick):
        width = sum(size for _, size in parts)
        if width < CODED or width > 48:
            raise ValueError("a window needs 15 to 48 bits")
        out.append((parts, steps(width, pick * threshold // blocks)))
    return out


def anchors(fps: np.ndarray, windows_: list, syn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, anchor key, whether it is the home) for an array of unsigned fingerprints."""
    for number, (parts, masks_of) in enumerate(windows_):
        width, value = 0, np.zeros(len(fps), np.int64)
        for low, size in parts:
            value |= ((fps >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64) << width
            width += size
        of = syn[value & ((1 << CODED) - 1)]
        for s, masks in enumerate(masks_of):
            rows = np.flatnonzero(of == s)
            for i, mask in enumerate(masks):
                yield rows, (value[rows] ^ mask) | (number << 48), i == 0


def _replicate(threshold: int, blocks: int, pick: int):
    windows_, syn = code(threshold, blocks, pick), syndromes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps, rep = pdf["fp"].to_numpy(np.int64), pdf["rep"].to_numpy(np.int64)
            found = list(anchors(fps.view(np.uint64), windows_, syn))
            rows = np.concatenate([r for r, _, _ in found])
            yield pd.DataFrame({
                "anchor": np.concatenate([k for _, k, _ in found]), "fp": fps[rows], "rep": rep[rows],
                "home": np.concatenate([np.full(len(r), h) for r, _, h in found]),
            })

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one edge per node that is not the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _compare(threshold: int):
    """Rows sorted by (anchor, salt, homes first): every row against the homes of its group.

    Groups may cross batches; only the homes of the last group (bounded by the salting) are kept.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        for pdf in batches:
            key = pdf["anchor"].to_numpy(np.int64), pdf["salt"].to_numpy(np.int64)
            fp, rep, home = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["rep"].to_numpy(np.int64), pdf["home"].to_numpy(bool)
            old = 0
            if held is not None:
                old = len(held[2])
                key = np.concatenate([held[0], key[0]]), np.concatenate([held[1], key[1]])
                fp, rep = np.concatenate([held[2], fp]), np.concatenate([held[3], rep])
                home = np.concatenate([np.full(old, True), home])
            n = len(fp)
            if not n:
                continue
            first = np.flatnonzero(np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
            homes = np.add.reduceat(home.astype(np.int64), first)
            count = homes[group]
            count[:old] = 0
            done = np.cumsum(count)
            links, at = [], 0
            while at < n:
                stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + COMPARED, "right")))
                c = count[at:stop]
                row = np.repeat(np.arange(at, stop), c)
                other = first[group[row]] + np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
                near = np.bitwise_count(fp[row] ^ fp[other]) <= threshold
                row, other = row[near], other[near]
                unlike = rep[row] != rep[other]
                if unlike.any():
                    links.append(_forest(rep[row[unlike]], rep[other[unlike]]))
                at = stop
            if links:
                a, b = _forest(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
                yield pd.DataFrame({"a": a, "b": b})
            last = np.arange(first[-1], first[-1] + homes[-1])
            held = key[0][last], key[1][last], fp[last], rep[last]

    return run


def links(fps: DataFrame, threshold: int = 4, blocks: int = 3, pick: int = 1, bucket: int = 8192) -> DataFrame:
    """Links (a, b) between representatives of distinct fingerprints (fp, rep).

    Not all pairs: within what a task compares, a spanning forest of the links, which has the
    same components. A bucket with more than `bucket` homes is cut by salt: homes are dealt out,
    the rows that visit them go to every salt; nothing is dropped.
    """
    rows = fps.select("fp", "rep").mapInPandas(
        _replicate(threshold, blocks, pick), "anchor long, fp long, rep long, home boolean")
    full = durable(rows.where("home").groupBy("anchor").agg(F.count(F.lit(1)).alias("homes")).where(F.col("homes") > bucket))
    salts = F.coalesce(F.ceil(F.col("homes") / bucket), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), salts).cast("int")
    rows = join_small(rows, full, "anchor").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    rows = rows.withColumn("home", F.col("home") & (F.col("salt") == own)).select("anchor", "salt", "fp", "rep", "home")
    dealt = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("home"))
    return dealt.mapInPandas(_compare(threshold), "a long, b long")


def component_labels(fps: DataFrame, threshold: int = 4, blocks: int = 3, pick: int = 1) -> DataFrame:
    """(fp, component_id) of rows (id, fp): the smallest id reachable over links."""
    nodes = durable(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    found = components(links(nodes.where("rep IS NOT NULL"), threshold, blocks, pick))
    return nodes.join(found, nodes["rep"] == found["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4,
    threshold: int = 4, blocks: int = 3, pick: int = 1,
) -> DataFrame:
    """(id, fp, component_id) per row of `docs`; the component is the smallest id reachable.

    Null and wordless texts have fingerprint 0 and link like any other. Rows with a null id get
    their fingerprint, and the component of rows with an id that share it, else null. Repeated rows
    stay. More than a few hundred million rows want `blocks=5, pick=2`: more replicas, far fewer
    comparisons. Other columns of `docs` are not read.
    """
    fps = durable(docs.select(F.col(id_col).cast("long").alias("id"), fingerprint(F.col(text_col), shingle_words).alias("fp")))
    return fps.join(component_labels(fps, threshold, blocks, pick), "fp", "left").select("id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, threshold: int = 4) -> DataFrame:
    """The rows of `docs` that stay, all columns: of each component the document with the smallest id.

    The rows are written once with their fingerprints; only the rows to drop are joined to them. Rows
    equal in id and fingerprint are repeats of one document, of which one stays.
    """
    marked = durable(docs.withColumn("__fp", fingerprint(F.col(text_col), shingle_words)).withColumn("__id", F.col(id_col).cast("long")))
    rows = durable(marked.groupBy(F.col("__id").alias("id"), F.col("__fp").alias("fp")).agg(F.count(F.lit(1)).alias("n")))
    labelled = rows.join(component_labels(rows, threshold), "fp")
    stays = F.col("id").eqNullSafe(F.col("component_id"))
    odd = durable(labelled.where(~stays | (F.col("n") > 1)).select(
        F.col("id").alias("__odd_id"), F.col("fp").alias("__odd_fp"), stays.alias("__again")))
    same = F.col("__id").eqNullSafe(F.col("__odd_id")) & (F.col("__fp") == F.col("__odd_fp"))
    joined = join_small(marked, odd, same)
    out = joined.where("__again IS NULL")
    if not bounded(odd.where("__again"), 0):
        out = out.unionByName(joined.where("__again").dropDuplicates(["__id", "__fp"]))
    return out.select(*docs.columns)
