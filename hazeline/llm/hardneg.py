"""Hard negatives by exact search over Hilbert-ordered blocks with zone maps.

Vectors are scaled to whole numbers and laid out along a Hilbert curve. Each `BLOCK` rows in that order
are one row of a Parquet table: ids, labels and vectors as bytes, and, as zone map, the least and the
greatest value per dimension and the labels present. Anchors travel in packs. For a pack and a chunk
of zone maps, interval arithmetic bounds the scores that a block can hold for each anchor; a block is
read for the anchors whose wanted scores (a window, or anything from a known fifth best on) meet those
bounds, and for no other. Scores are whole numbers, so the bounds and the results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import regroup
from hazeline.session import durable

#: Rows per block, anchors per pack, zone maps looked at together.
BLOCK, PACK, CHUNK = 1024, 1024, 512
#: Dimensions and bits of the curve: 64 bits of key, of the widest among the first dimensions.
AXES, BITS, TRIED = 16, 4, 64
#: Scores are exact below this and clipped there.
LIMIT = 1 << 56
_PAIR = "anchor long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of `cells`, whole numbers below 2**bits; at most 64 bits in all."""
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):  # turn and flip the sub-cubes, from the largest
        below = np.uint64((1 << level) - 1)
        for axis in x:
            flip = (axis >> np.uint64(level)) & one == one
            swap = np.where(flip, 0, (x[0] ^ axis) & below).astype(np.uint64)
            x[0] ^= np.where(flip, below, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & one == one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << one) | ((axis >> np.uint64(level)) & one)
    return key


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of whole numbers as int64, clipped to +-LIMIT."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * max(-int(a.min()), int(a.max())) * max(-int(b.min()), int(b.max()))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T if most > LIMIT else a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each anchor with any vector between low and high, per block."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


@dataclass(frozen=True)
class Layout:
    """Shape of the vectors of a table and the grid of its curve."""

    rows: int
    dims: int
    kind: str  # little-endian numpy type that holds every component
    axes: tuple[int, ...]
    start: tuple[float, ...]
    width: tuple[float, ...]

    def matrix(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.dims) if self.dims else np.zeros((0, 0), self.kind)


def usable(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vec) of the rows that take part, scaled to whole numbers, each once."""
    vec = F.col(vec_col)
    whole = F.transform(vec, lambda x: F.floor(scale * x.cast("double")).cast("long"))
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vec.isNotNull() & ~odd).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("vec")).distinct()


def layout(rows: DataFrame) -> Layout:
    """One pass for the shape, one for the spread of the first `TRIED` dimensions."""
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"),
        F.max(F.greatest(F.array_max("vec"), -1 - F.array_min("vec"))).alias("m")).first()
    dims, most = size["d"] or 0, size["m"] or 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    tried = range(min(dims, TRIED))
    at = [F.coalesce(F.get("vec", F.lit(i)), F.lit(0)).cast("double") for i in tried]
    spread = rows.agg(*[F.avg(x).alias(f"a{i}") for i, x in enumerate(at)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(at)]).first() if dims else {}
    axes = tuple(sorted(tried, key=lambda i: (-(spread[f"s{i}"] or 0.0), i))[:AXES])
    width = tuple(max(4 * (spread[f"s{i}"] or 0.0), 1.0) for i in axes)
    return Layout(size["n"], dims, kind, axes, tuple((spread[f"a{i}"] or 0.0) - w / 2 for i, w in zip(axes, width)), width)


def _long(values: np.ndarray) -> bytes:
    return np.asarray(values, "<i8").tobytes()


def _best(score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` greatest scores, ties by smaller id."""
    at = np.arange(len(score))
    if len(score) > 4 * top:
        at = np.flatnonzero(score >= np.partition(score, len(score) - top)[len(score) - top])
    return at[np.lexsort((ids[at], -score[at]))[:top]]


def build_blocks(rows: DataFrame, shape: Layout, is_anchor: Column, positives: int, block_rows: int = BLOCK) -> DataFrame:
    """The block table, one row per block, with the places of its anchors (`at`) and per anchor a `floor`:
    the score of the last of its best same-label rows in its own block, which its positives reach."""
    axes, start, width = list(shape.axes), np.array(shape.start), np.array(shape.width)
    dims, kind, cells = shape.dims, shape.kind, 1 << BITS

    def padded(vecs: pd.Series) -> np.ndarray:
        out = np.zeros((len(vecs), dims), kind)
        for row, v in zip(out, vecs):
            row[:len(v)] = v
        return out

    @F.pandas_udf("long")
    def place(vecs: pd.Series) -> pd.Series:
        at = np.clip(np.floor((padded(vecs)[:, axes] - start) / width * cells), 0, cells - 1)
        return pd.Series(hilbert_key(at, BITS).view(np.int64) ^ np.int64(-1 << 63))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        for number, pdf in enumerate(regroup(pdfs, block_rows)):
            ids, labels, vecs = pdf["id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), padded(pdf["vec"])
            at, floors = np.flatnonzero(pdf["is_anchor"].to_numpy(bool)), []
            for i, score in zip(at, products(vecs[at], vecs)):
                near = score[(labels == labels[i]) & (ids != ids[i])]
                floors.append(np.partition(near, len(near) - positives)[len(near) - positives] if len(near) >= positives else -LIMIT)
            yield pd.DataFrame([(
                first + number, len(ids), _long(ids), _long(labels), vecs.tobytes(), vecs.min(axis=0).tobytes(), vecs.max(axis=0).tobytes(),
                _long(np.unique(labels)), _long(at), _long(np.array(floors, np.int64)))],
                columns=["block", "n", "ids", "labels", "vecs", "low", "high", "kinds", "at", "floors"])

    keyed = rows.withColumn("key", place("vec") if dims else F.lit(0).cast("long")).withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False)))
    parts = max(1, -(-shape.rows // (8 * block_rows)))
    sorted_rows = keyed.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id", "label", "vec")
    return durable(sorted_rows.mapInPandas(run, (
        "block long, n int, ids binary, labels binary, vecs binary, low binary, high binary, kinds binary, at binary, floors binary")))


def build_packs(blocks: DataFrame, shape: Layout, pack_rows: int = PACK) -> DataFrame:
    """Anchors in the order of the curve, `pack_rows` at a time: (pack, ids, labels, vecs, floors)."""
    def spread(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for b in pdf.itertuples():
                at = np.frombuffer(b.at, "<i8")
                vecs = shape.matrix(b.vecs) if shape.dims else np.zeros((b.n, 0), shape.kind)
                yield pd.DataFrame({
                    "block": b.block, "id": np.frombuffer(b.ids, "<i8")[at], "label": np.frombuffer(b.labels, "<i8")[at],
                    "vec": [v.tobytes() for v in vecs[at]], "floor": np.frombuffer(b.floors, "<i8")})

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 16
        for number, pdf in enumerate(regroup(pdfs, pack_rows)):
            yield pd.DataFrame([(first + number, _long(pdf["id"]), _long(pdf["label"]), b"".join(pdf["vec"]), _long(pdf["floor"]))],
                               columns=["pack", "ids", "labels", "vecs", "floors"])

    anchors = durable(blocks.where(F.length("at") > 0).select("block", "n", "ids", "labels", "vecs", "at", "floors").mapInPandas(
        spread, "block long, id long, label long, vec binary, floor long"))
    parts = max(1, -(-anchors.count() // (4 * pack_rows)))
    return durable(anchors.repartitionByRange(parts, "block", "id").sortWithinPartitions("block", "id", "label", "vec").mapInPandas(
        run, "pack long, ids binary, labels binary, vecs binary, floors binary"))


def choose_blocks(packs: DataFrame, blocks: DataFrame, shape: Layout, wanted: Callable, same_label: bool) -> DataFrame:
    """(pack, block, need): the anchors of the pack, as bits, that have to see the block.

    `wanted(row)` gives the score windows (least, greatest), an array of anchors x windows each. Zone
    maps meet packs in chunks of about `CHUNK`, read without the vectors.
    """
    zones = blocks.select("block", "low", "high", "kinds")
    chunks = max(1, -(-zones.count() // CHUNK))
    zones = zones.groupBy(F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk")).agg(
        F.collect_list(F.struct("block", "low", "high", "kinds")).alias("zones"))
    asked = packs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples():
                labels, zones = np.frombuffer(row.labels, "<i8"), row.zones
                a = np.frombuffer(row.vecs, shape.kind).reshape(len(labels), shape.dims)
                low, high = (np.array([np.frombuffer(z[side], shape.kind) for z in zones]) for side in ("low", "high"))
                least, most = bounds(a, low, high)
                fits = np.zeros(least.shape, bool)
                for start, stop in zip(*(w.T for w in wanted(row))):
                    fits |= (most >= start[:, None]) & (least <= stop[:, None])
                for i, z in enumerate(zones):
                    kinds = np.frombuffer(z["kinds"], "<i8")
                    there = np.isin(labels, kinds)
                    fits[:, i] &= there if same_label else ~there | (len(kinds) > 1)
                some = np.flatnonzero(fits.any(axis=0))
                yield pd.DataFrame({
                    "pack": row.pack, "block": [zones[i]["block"] for i in some],
                    "need": [np.packbits(fits[:, i]).tobytes() for i in some]})

    return asked.join(zones, "chunk").mapInPandas(run, "pack long, block long, need binary")


def read_blocks(chosen: DataFrame, packs: DataFrame, blocks: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """Runs `kernel(rows)` over the chosen (pack, block) pairs, those of a pack one after the other where Spark lets them."""
    names = {c: f"b_{c}" for c in ("ids", "labels", "vecs")}
    held = blocks.select("block", *[F.col(c).alias(n) for c, n in names.items()])
    pairs = chosen.join(held, "block").join(packs, "pack")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from kernel(row for pdf in pdfs for row in pdf.itertuples())

    return pairs.mapInPandas(run, schema)


def _tiles(rows: Iterator, shape: Layout) -> Iterator[tuple]:
    """(row, anchor numbers, their scores, block ids, block labels, anchor ids, anchor labels)."""
    for row in rows:
        ids, labels = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.labels, "<i8")
        b_ids, b_labels = np.frombuffer(row.b_ids, "<i8"), np.frombuffer(row.b_labels, "<i8")
        need = np.flatnonzero(np.unpackbits(np.frombuffer(row.need, np.uint8))[:len(ids)])
        a = np.frombuffer(row.vecs, shape.kind).reshape(len(ids), shape.dims)[need]
        b = np.frombuffer(row.b_vecs, shape.kind).reshape(len(b_ids), shape.dims)
        yield row, need, products(a, b), b_ids, b_labels, ids, labels


class _Top:
    """The best (score, id) per key, merged from block to block."""

    def __init__(self, top: int) -> None:
        self.top, self.held = top, {}

    def add(self, key, score: np.ndarray, ids: np.ndarray) -> None:
        if key in self.held:
            score, ids = np.concatenate([self.held[key][0], score]), np.concatenate([self.held[key][1], ids])
        at = _best(score, ids, self.top)
        self.held[key] = score[at], ids[at]


def _first(df: DataFrame, keys: list[str], score: str, by: str, top: int, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), by)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= top)


def find_positives(packs: DataFrame, blocks: DataFrame, shape: Layout, top: int) -> DataFrame:
    """(pack, number, place, id, score): the first `top` other rows of the label of each anchor, place from 1."""
    def wanted(row) -> tuple[np.ndarray, np.ndarray]:
        floor = np.frombuffer(row.floors, "<i8")[:, None]
        return floor, np.full_like(floor, LIMIT)

    def kernel(rows: Iterator) -> Iterator[pd.DataFrame]:
        pack, held = None, _Top(top)

        def flush() -> pd.DataFrame:
            out = [(pack, k, i, s) for k, (score, ids) in held.held.items() for s, i in zip(score.tolist(), ids.tolist())]
            return pd.DataFrame(out, columns=["pack", "number", "id", "score"])

        for row, need, scores, b_ids, b_labels, ids, labels in _tiles(rows, shape):
            if row.pack != pack:
                if held.held:
                    yield flush()
                pack, held = row.pack, _Top(top)
            for number, score in zip(need.tolist(), scores):
                fits = np.flatnonzero((b_labels == labels[number]) & (b_ids != ids[number]))
                if len(fits):
                    held.add(number, score[fits], b_ids[fits])
        if held.held:
            yield flush()

    chosen = choose_blocks(packs, blocks, shape, wanted, same_label=True)
    found = read_blocks(chosen, packs, blocks, kernel, "pack long, number int, id long, score long")
    return _first(found, ["pack", "number"], "score", "id", top, "place")


def find_negatives(packs: DataFrame, blocks: DataFrame, shape: Layout, top: int, percent: int) -> DataFrame:
    """The first `top` rows of another label in the window of each positive; `packs` has a list `pos` of (number, place, id, score)."""
    def windows(row) -> dict[int, list]:
        by: dict[int, list] = {}
        for p in row.pos:
            by.setdefault(p["number"], []).append((p["place"], p["id"], p["score"], -(-percent * p["score"] // 100)))
        return by

    def wanted(row) -> tuple[np.ndarray, np.ndarray]:
        by = windows(row)
        size, many = len(row.ids) // 8, max(map(len, by.values()))
        least, most = np.full((size, many), LIMIT), np.full((size, many), -LIMIT)
        for number, held in by.items():
            for i, (_, _, score, start) in enumerate(held):
                least[number, i], most[number, i] = start, score
        return least, most

    def kernel(rows: Iterator) -> Iterator[pd.DataFrame]:
        pack, held, by, own = None, _Top(top), {}, None

        def flush() -> pd.DataFrame:
            out = []
            for (number, i), (score, ids) in held.held.items():
                place, positive, reach, _ = by[number][i]
                out += [((pack << 32) + number, own[number], place, positive, reach, n, s) for s, n in zip(score.tolist(), ids.tolist())]
            return pd.DataFrame(out, columns=[c.split()[0] for c in _PAIR.split(", ")])

        for row, need, scores, b_ids, b_labels, ids, labels in _tiles(rows, shape):
            if row.pack != pack:
                if held.held:
                    yield flush()
                pack, held, by, own = row.pack, _Top(top), windows(row), ids
            for number, score in zip(need.tolist(), scores):
                mine = by[number]
                at = np.flatnonzero((b_labels != labels[number]) & (score <= max(w[2] for w in mine)) & (score >= min(w[3] for w in mine)))
                at = at[np.lexsort((b_ids[at], -score[at]))]
                falling = -score[at]
                for i, (_, _, reach, start) in enumerate(mine):
                    first = int(np.searchsorted(falling, -reach))
                    part = at[first:min(first + top, int(np.searchsorted(falling, -start, side="right")))]
                    if len(part):
                        held.add((number, i), score[part], b_ids[part])
        if held.held:
            yield flush()

    chosen = choose_blocks(packs, blocks, shape, wanted, same_label=False)
    found = read_blocks(chosen, packs, blocks, kernel, _PAIR)
    return _first(found, ["anchor", "anchor_id", "place", "positive_id", "positive_score"], "negative_score", "negative_id", top, "rank")


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK, pack_rows: int = PACK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the product of the vectors scaled by `scale` and floored; greater ones come first, ties
    by smaller id. Anchors are the rows with `is_anchor` (over columns id, label, vec). For each anchor
    and each of its first `positives` rows of the same label with another id come the first `negatives`
    rows of another label whose score is at least `percent` percent of the positive's and at most equal to it.

    Rows without id, label or vector, or with a null or non-finite component, take no part; rows equal
    in id, label and vector count once; shorter vectors end in zeros. An anchor without positives, or a
    positive without negatives in its window (any of a score below zero), has no rows. An empty table gives none.
    """
    rows = durable(usable(rows, id_col, vec_col, label_col, scale))
    shape = layout(rows)
    blocks = build_blocks(rows, shape, is_anchor, positives, block_rows)
    packs = build_packs(blocks, shape, pack_rows)
    pos = durable(find_positives(packs, blocks, shape, positives))
    grouped = pos.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("number", "place", "id", "score"))).alias("pos"))
    asked = durable(packs.drop("floors").join(grouped, "pack"))
    found = find_negatives(asked, blocks, shape, negatives, percent)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
