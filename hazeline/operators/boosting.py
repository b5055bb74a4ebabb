"""Quantile gradient boosting over binned features."""

from __future__ import annotations

import heapq
import json
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn, _to_java_column, _to_seq

from hazeline.constants import FEATURES_72H, POLLUTANTS, QUANTILES
from hazeline.functions.numeric import nan_to_null
from hazeline.operators.ordered import exact_percentiles
from hazeline.session import durable, shared_folder


def _codes(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every value (rows x features): 0 where it is missing, else 1 + the number of edges below it."""
    out = np.empty(values.shape, np.int16)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(values[:, j]), 0, 1 + np.searchsorted(e, values[:, j], "left"))
    return out


def _columns(codes: np.ndarray) -> np.ndarray:
    """Bins (rows x features) by feature, a byte each: comparisons with a cut run over whole columns."""
    return np.ascontiguousarray(codes.T.astype(np.uint8))


#: Which rows of a node are counted: all, those above the prediction, those at or below it.
BOTH, ABOVE, BELOW = 2, 1, 0


def _walk(splits: Sequence[tuple[int, int, int, int]], numbers: dict[int, int], depth: int, side: int = BOTH) -> np.ndarray:
    """Splits (node, feature, bin, left child) of a tree by node: left children, features, bins, numbers (-1: none).

    The right child follows the left one. A node without a split leads to itself: no bin lies above 255.
    """
    size = 2 * len(splits) + 1
    left, feature, cut, number = np.arange(size), np.zeros(size, int), np.full(size, 255), np.full(size, -1)
    for node, f, c, child in splits:
        left[node], feature[node], cut[node] = child, f, c
    for node, i in numbers.items():
        number[node] = i
    return np.concatenate([[depth, side, size], left, feature, cut, number])


@dataclass
class Tree:
    """Splits in the order they were made: rows of `leaf` with a bin above `bins` become leaf number 1, 2, ... (one per split)."""

    leaf: np.ndarray
    feature: np.ndarray
    bins: np.ndarray
    value: np.ndarray

    def leaves(self, columns: np.ndarray) -> np.ndarray:
        """Leaf of each row of `columns` (features x rows): a split takes marks of rows, no row walks the tree."""
        marked, out = [np.ones(columns.shape[1], bool)], np.zeros(columns.shape[1], np.uint8)
        for k, (leaf, feature, cut) in enumerate(zip(self.leaf.tolist(), self.feature.tolist(), self.bins.tolist()), 1):
            right = marked[leaf] & (columns[feature] > cut)
            marked[leaf] = marked[leaf] ^ right
            marked.append(right)
            out += right.view(np.uint8) * np.uint8(k - leaf)
        return out

    def assign(self, codes: np.ndarray) -> np.ndarray:
        """Leaf of each row of bins (rows x features)."""
        return self.leaves(_columns(codes))

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.assign(codes)]

    def walk(self) -> np.ndarray:
        """The tree as the passes take it, its leaves numbered."""
        splits, at, depth = [], {0: 0}, {0: 0}
        for k, (leaf, feature, cut) in enumerate(zip(self.leaf.tolist(), self.feature.tolist(), self.bins.tolist()), 1):
            splits.append((at[leaf], feature, cut, 2 * k - 1))
            at[leaf], at[k] = 2 * k - 1, 2 * k
            depth[leaf] = depth[k] = depth[leaf] + 1
        return _walk(splits, {node: leaf for leaf, node in at.items()}, max(depth.values()))

    def nodes(self, edges: Sequence[np.ndarray]) -> tuple[list[dict], int]:
        """The tree as nodes (f, t, l, r, v) over raw values, the root first, and its depth; a leaf has f = -1.

        A value goes to `r` where it exists and does not lie at or below `t`; that is NaN where all that exists goes to `r`.
        """
        nodes: list[dict] = [{"f": -1, "t": 0.0, "l": 0, "r": 0, "v": float(self.value[0])}]
        at, depth = {0: 0}, {0: 0}
        for k, (leaf, feature, cut) in enumerate(zip(self.leaf.tolist(), self.feature.tolist(), self.bins.tolist()), 1):
            here = at[leaf]
            left, right = len(nodes), len(nodes) + 1
            nodes += [{**nodes[here]}, {**nodes[here], "v": float(self.value[k])}]
            nodes[here] = {"f": feature, "t": float(edges[feature][cut - 1]) if cut else float("nan"), "l": left, "r": right, "v": 0.0}
            at[leaf], at[k] = left, right
            depth[leaf] = depth[k] = depth[leaf] + 1
        return nodes, max(depth.values())


@dataclass
class QuantileModels:
    """Boosted trees of many (label, quantile) cells over one set of binned features."""

    features: list[str]
    cells: list[tuple[str, float]]
    edges: list[np.ndarray]
    base: list[float]
    rate: float
    rounds: list[list[Tree]] = field(default_factory=list)

    def predict(self, codes: np.ndarray) -> np.ndarray:
        columns, out = _columns(codes), np.tile(np.array(self.base, float)[:, None], len(codes))
        for trees in self.rounds:
            for m, tree in enumerate(trees):
                out[m] += self.rate * tree.value[tree.leaves(columns)]
        return np.ascontiguousarray(out.T)

    def transform(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """Adds one prediction column per cell, in Arrow batches: for many rows."""
        model = self

        @F.pandas_udf("array<double>")
        def scores(*columns: pd.Series) -> pd.Series:
            values = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns])
            return pd.Series(list(model.predict(_codes(values, model.edges))))

        scored = df.withColumn("_scores", scores(*[F.col(f).cast("double") for f in self.features]))
        return scored.withColumns({n: F.col("_scores")[i] for i, n in enumerate(names)}).drop("_scores")

    def columns(self) -> list[Column]:
        """The same predictions as expressions, one per cell: no Python worker in the plan.

        The nodes of a cell's trees are constants of a function of `boosting.java`. A row makes its features once
        and walks each tree from its root; the rate times the leaf's value is added, in the order of the rounds.
        """
        spark = SparkSession.getActiveSession()
        passes = _passes(spark)
        values = F.array(*[F.col(f).cast("double") for f in self.features])

        def of_cell(m: int) -> Column:
            nodes, roots = [], []
            for trees in self.rounds:
                first = len(nodes)
                roots.append(first)
                nodes += [(n["f"], first + n["l"], first + n["r"], n["t"], self.rate * n["v"]) for n in trees[m].nodes(self.edges)[0]]
            feature, left, right = (np.array([n[i] for n in nodes], "<i4").tobytes() for i in range(3))
            above, step = (np.array([n[i] for n in nodes], "<f8").tobytes() for i in (3, 4))
            score = passes.score(float(self.base[m]), np.array(roots, "<i4").tobytes(), feature, left, right, above, step)
            return F.transform(F.array(values), lambda row: _applied(spark, score, row))[0]

        return [of_cell(m) for m in range(len(self.cells))]

    def save(self, spark: SparkSession, path: str) -> None:
        doc = {"features": self.features, "cells": self.cells, "edges": [e.tolist() for e in self.edges],
               "base": self.base, "rate": self.rate,
               "rounds": [[[t.leaf.tolist(), t.feature.tolist(), t.bins.tolist(), t.value.tolist()] for t in trees] for trees in self.rounds]}
        spark.createDataFrame([(json.dumps(doc),)], "model string").write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "QuantileModels":
        doc = json.loads(spark.read.text(path).first()[0])
        rounds = [[Tree(*[np.array(x, int) for x in t[:3]], np.array(t[3], float)) for t in trees] for trees in doc["rounds"]]
        return cls(doc["features"], [(c, q) for c, q in doc["cells"]], [np.array(e) for e in doc["edges"]],
                   doc["base"], doc["rate"], rounds)


def _chunks(batches: Iterable[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about `rows` rows."""
    held, n = [], 0
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            held.append(pdf.iloc[at:at + rows])
            n += len(held[-1])
            if n >= rows:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _thinned(values: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """The sorted values, or the middles of `most` equal shares of them, and how many values each one stands for."""
    values = np.sort(values)
    n = len(values)
    if n <= most:
        return values, 1.0
    return values[((np.arange(most) + 0.5) * n / most).astype(np.int64)], n / most


def _quantiles(parts: Sequence[tuple[np.ndarray, float]], at: Sequence[float]) -> list[float]:
    """For each share of `at`, the first of the weighted values up to which that share lies."""
    values = np.concatenate([v for v, _ in parts])
    order = values.argsort(kind="stable")
    upto = np.concatenate([np.full(len(v), w) for v, w in parts])[order].cumsum()
    found = np.searchsorted(upto, np.array(at) * upto[-1] * (1 - 1e-12), "left")
    return values[order][np.minimum(found, len(values) - 1)].tolist()


def _quantile(parts: Sequence[tuple[np.ndarray, float]], q: float) -> float:
    return _quantiles(parts, [q])[0]


def _bin_edges(df: DataFrame, features: Sequence[str], bins: int, accuracy: int = 10_000) -> list[np.ndarray]:
    """Distinct inner quantiles of each feature, missing values and NaN left out: at most `bins` - 1 numbers per feature.

    Every 262,144 rows at most send `accuracy` values a feature to the task that merges the feature (relative rank error
    1/accuracy); fewer rows than that are exact.
    """
    at = [k / bins for k in range(1, bins)]

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _chunks(batches, 262_144):
            parts = []
            for i in range(len(features)):
                v = pdf[f"x{i}"].to_numpy(float, na_value=np.nan)
                values, weight = _thinned(v[~np.isnan(v)], accuracy)
                parts.append((i, values.tobytes(), weight))
            yield pd.DataFrame([part for part in parts if part[1]], columns=["i", "v", "w"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.frombuffer(v, float), w) for v, w in zip(pdf["v"], pdf["w"])]
        return pd.DataFrame({"i": pdf["i"][:1], "e": [np.unique(_quantiles(parts, at))]})

    columns = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    sketch = columns.mapInPandas(sketched, "i int, v binary, w double")
    found = {r["i"]: r["e"] for r in sketch.groupBy("i").applyInPandas(merged, "i int, e array<double>").collect()}
    return [np.array(found.get(i, []), float) for i in range(len(features))]


class _Growing:
    """One tree in the making, best gain first.

    `known` holds, per node, its histogram (rows and rows above the prediction, by feature and bin) and its
    best split. `grow` replays the best-first order over what is known; nodes that it splits and whose
    children are not known yet are to be counted next, of each pair of children the smaller one only.
    """

    def __init__(self, alpha: float, leaves: int, depth: int, min_leaf: int) -> None:
        self.alpha, self.leaves, self.depth, self.min_leaf = alpha, leaves, depth, min_leaf
        self.known: dict[int, tuple] = {}  # node: (histogram, gain, feature, bin, depth)
        self.children: dict[int, tuple[int, int]] = {}
        self.order: list[int] = []
        self.wanted: dict[int, int] = {0: 0}  # node to count: its parent (the root: itself)

    def _learn(self, node: int, hist: np.ndarray, depth: int) -> None:
        n, above = hist.astype(float).cumsum(axis=2)
        g = above * self.alpha + (n - above) * (self.alpha - 1)
        right, total = n[:, -1:] - n, g[:, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g**2 / n + (total - g) ** 2 / right - total**2 / n[:, -1:]
        gain[(n < self.min_leaf) | (right < self.min_leaf)] = -1.0
        feature, cut = np.unravel_index(gain.argmax(), gain.shape) if gain.size else (0, 0)
        self.known[node] = hist, float(gain[feature, cut]) if gain.size else -1.0, int(feature), int(cut), depth

    def learn(self, counted: Sequence[np.ndarray]) -> None:
        """The histograms of the wanted nodes, in their order."""
        for (node, parent), hist in zip(self.wanted.items(), counted):
            if node == parent:
                self._learn(node, hist, 0)
                continue
            left, right = self.children[parent]
            depth = self.known[parent][4] + 1
            self._learn(node, hist, depth)
            self._learn(left + right - node, self.known[parent][0] - hist, depth)
        self.wanted = {}

    def grow(self) -> None:
        queue, self.order = [(-self.known[0][1], 0)], []
        unknown = []
        while queue and len(self.order) < self.leaves - 1:
            gain, node = heapq.heappop(queue)
            if gain >= 0:
                break
            self.order.append(node)
            if node in self.children and self.children[node][0] in self.known:
                queue_up = [c for c in self.children[node] if self.known[c][4] < self.depth]
                for c in queue_up:
                    heapq.heappush(queue, (-self.known[c][1], c))
            elif self.known[node][4] + 1 < self.depth:
                unknown.append(node)
        if len(self.order) == self.leaves - 1 and unknown[-1:] == self.order[-1:]:
            unknown.pop()  # nothing can be split after it
        for node in unknown:
            hist, _, feature, cut, _ = self.known[node]
            self.children[node] = left, right = (2 * len(self.children) + 1, 2 * len(self.children) + 2)
            below = hist[0, feature, :cut + 1].sum()
            self.wanted[left if 2 * below <= hist[0, feature].sum() else right] = node

    def walk(self, side: int = BOTH) -> np.ndarray:
        """The splits so far and the numbers of the nodes to count, as a task needs them: no histograms."""
        splits = [(node, *self.known[node][2:4], pair[0]) for node, pair in self.children.items()] if self.wanted else []
        deepest = max((self.known[node][4] + 1 for node, *_ in splits), default=0)
        return _walk(splits, {node: i for i, node in enumerate(self.wanted)}, deepest, side)

    def tree(self) -> Tree:
        leaf_of, splits = {0: 0}, []
        for k, node in enumerate(self.order, 1):
            _, _, feature, cut, _ = self.known[node]
            splits.append((leaf_of[node], feature, cut))
            if node in self.children:
                left, right = self.children[node]
                leaf_of[left], leaf_of[right] = leaf_of[node], k
        leaf, feature, cut = (np.array(x, int) for x in zip(*splits)) if splits else (np.zeros(0, int),) * 3
        return Tree(leaf, feature, cut, np.zeros(len(splits) + 1))


#: Rows of the training table that one task holds at most, and rows of one block in it.
ROWS_PER_TASK, ROWS_PER_BLOCK = 500_000, 16_384

def _passes(spark: SparkSession):
    """The passes of `boosting.java`, compiled by Spark's own compiler and sent to the executors once per application."""
    sc = spark.sparkContext
    if not hasattr(sc, "_hazeline_passes"):  # not in this module: it goes to Python workers by value
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(Path(__file__).with_name("boosting.java").read_text())
        jar = Path(tempfile.mkdtemp(prefix="hazeline-passes-")) / f"hazeline-{uuid.uuid4().hex}.jar"
        with zipfile.ZipFile(jar, "w") as out:
            for name, code in compiler.getBytecodes().items():
                out.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        sc._jsc.addJar(str(jar))
        none = sc._gateway.new_array(sc._jvm.java.lang.Class, 0), sc._gateway.new_array(sc._jvm.java.lang.Object, 0)
        made = compiler.getClassLoader().loadClass("hazeline.Boosting").getDeclaredConstructor(none[0]).newInstance(none[1])
        sc._hazeline_passes = made
    return sc._hazeline_passes


def _applied(spark: SparkSession, function, column: Column) -> Column:
    """A function of the JVM applied to one column."""
    return ClassicColumn(function.apply(_to_seq(spark.sparkContext, [column], _to_java_column)))


def _dealt(sizes: dict[int, int], tasks: int) -> dict[int, int]:
    """The task of each block: the largest first, to whichever task has fewest rows."""
    loads = [(0, task) for task in range(tasks)]
    out = {}
    for block, n in sorted(sizes.items(), key=lambda item: (-item[1], item[0])):
        rows, task = heapq.heappop(loads)
        out[block] = task
        heapq.heappush(loads, (rows + n, task))
    return out


def _packed(walks: Sequence[np.ndarray]) -> bytes:
    return np.concatenate([[len(walks)], *walks]).astype("<i4").tobytes()


def fit_quantiles(
    df: DataFrame, features: Sequence[str], cells: Sequence[tuple[str, float]], trees: int = 80, rate: float = 0.08,
    leaves: int = 31, depth: int = 6, min_leaf: int = 20, bins: int = 32, accuracy: int = 2_000, cut_every: int = 10, fan_in: int = 32,
) -> QuantileModels:
    """Boosted trees for all (label, quantile) cells at once, grown best gain first to at most `leaves` leaves.

    Features are binned once and the table is packed into blocks of rows (bins, and what the labels exceed the
    predictions by), which stay with the executors, in memory or on their disks, and are written to the shared
    folder every `cut_every` rounds. The passes over them are those of `boosting.java`: no row comes to a Python
    worker. A pass counts histograms, of rows and of rows above the prediction, by (cell, node), added up in the
    task, for the smaller child of each new split; the other one is the difference to the parent. Rows in the
    root are counted once; then each round counts there the rows on one side of the prediction, the side with
    fewer rows. These sums are whole numbers and do not grow with the rows; the driver, which chooses the splits,
    gets those of at most `fan_in` tasks, beyond that they are added up by tasks in between. Passes go on until
    the best-first order is settled, at most `depth` times. Leaves take the residual quantile of their rows: each
    task sends at most `accuracy` values a leaf to the task that merges the leaf (relative rank error
    1/accuracy); the start value is exact. Rows without a label count for the other labels only; a label without
    any value predicts 0.
    """
    labels = sorted({c for c, _ in cells})
    edges = _bin_edges(df, features, bins)
    wide, width = len(features), max((len(e) for e in edges), default=0) + 2
    if width > 256:
        raise ValueError(f"{bins} bins do not fit a byte")
    model = QuantileModels(list(features), list(cells), edges, [], rate)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_g"), nan_to_null(F.col(c).cast("double")).alias("_y")) for c in labels])).alias("r")).select("r.*").where("_y IS NOT NULL")
    wanted = sorted({q for _, q in cells})
    starts = {r["_g"]: r for r in exact_percentiles(long, ["_g"], "_y", {f"q{i}": q for i, q in enumerate(wanted)}).collect()}
    model.base = [float(starts[c][f"q{wanted.index(q)}"]) if c in starts else 0.0 for c, q in cells]
    alphas = np.array([q for _, q in cells])

    spark = df.sparkSession
    sc, passes = spark.sparkContext, _passes(spark)
    rows = df.count()
    tasks = max(sc.defaultParallelism, -(-rows // ROWS_PER_TASK))  # every pass reads all rows: spread them over the cluster
    block = max(1, min(ROWS_PER_BLOCK, -(-rows // (2 * tasks))))

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _chunks(batches, block):
            codes = _codes(pdf[[f"x{i}" for i in range(wide)]].to_numpy(float, na_value=np.nan), edges)
            y = np.ascontiguousarray(pdf[[f"y{i}" for i in range(len(labels))]].to_numpy(float, na_value=np.nan).T)
            yield pd.DataFrame({"codes": [codes.astype(np.uint8).tobytes()], "y": [y.astype("<f8").tobytes()], "n": [len(pdf)]})

    table = df.select(
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
        *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(labels)])
    packed = table.mapInPandas(binned, "codes binary, y binary, n long")
    packed = durable(packed.select(F.monotonically_increasing_id().alias("block"), "codes", "y", "n"))
    task_of = sorted(_dealt({r["block"]: r["n"] for r in packed.select("block", "n").collect()}, tasks).items())

    def handed(numbers, kind) -> np.ndarray:
        with tempfile.TemporaryDirectory(prefix="hazeline-sums-") as folder:
            passes.write(numbers, f"{folder}/numbers")
            return np.fromfile(f"{folder}/numbers", kind)

    def added_up(walks: Sequence[np.ndarray]) -> np.ndarray:
        """Rows and rows above: nodes x 2 x features x bins, the nodes to count of all cells after one another."""
        counts = work.mapPartitions(passes.count(_packed(walks), wide, width))
        total = counts.reduce(passes.add()) if tasks <= fan_in else counts.treeReduce(passes.add(), 2)
        below, above = np.moveaxis(handed(total, "<i8").reshape(-1, wide, width, 2), 3, 0)
        return np.stack([below + above, above], axis=1)

    level = sc._jvm.org.apache.spark.storage.StorageLevel.MEMORY_AND_DISK()
    shared_folder(spark)
    deal = passes.deal(*[np.array([pair[i] for pair in task_of], kind).tobytes() for i, kind in ((0, "<i8"), (1, "<i4"))])
    start = passes.start(np.array([labels.index(c) for c, _ in cells], "<i4").tobytes(), np.array(model.base, "<f8").tobytes())
    parts = sc._jvm.org.apache.spark.HashPartitioner(tasks)
    work = packed._jdf.javaRDD().mapToPair(deal).partitionBy(parts).values().map(start).persist(level)
    before = everyone = None
    for k in range(trees):
        growing = [_Growing(q, leaves, depth, min_leaf) for q in alphas]
        rarer = [BOTH if everyone is None else BELOW if q < 0.5 else ABOVE for q in alphas]
        roots = added_up([g.walk(side) for g, side in zip(growing, rarer)])
        if before is not None:
            before.unpersist()
        if everyone is None:
            everyone = roots[:, 0].copy()
        for m, (g, side) in enumerate(zip(growing, rarer)):
            n, found = everyone[m], roots[m]
            g.learn([np.stack([n, n - found[0] if side == BELOW else found[1]])])
            g.grow()
        while any(g.wanted for g in growing):
            found = iter(added_up([g.walk() for g in growing]))
            for g in growing:
                g.learn([next(found) for _ in g.wanted])
                g.grow()
        grown = [g.tree() for g in growing]
        walks, most = _packed([tree.walk() for tree in grown]), max(len(tree.value) for tree in grown)
        left = work.mapPartitionsToPair(passes.leftOver(walks, wide, most, accuracy)).groupByKey(min(tasks, fan_in))
        merged = left.mapPartitions(passes.merge(alphas.astype("<f8").tobytes(), most)).reduce(passes.join())
        for key, value in handed(merged, [("key", "<i8"), ("value", "<f8")]).tolist():
            grown[key // most].value[key % most] = value
        model.rounds.append(grown)
        if k + 1 < trees:
            steps = np.stack([np.pad(rate * tree.value, (0, most - len(tree.value))) for tree in grown]).astype("<f8").tobytes()
            before, work = work, work.map(passes.boost(walks, steps, wide, most)).persist(level)
            if (k + 1) % cut_every == 0:
                work.checkpoint()
    work.unpersist()
    return model


def train_quantile_models(train: DataFrame, pollutants=POLLUTANTS, quantiles=QUANTILES, trees: int = 80, **options) -> QuantileModels:
    """Models of every pollutant and quantile over the 22 features of the sample matrix."""
    cells = [(f"target_{p}", q) for p in pollutants for q in quantiles]
    rows = durable(train.select(*FEATURES_72H, *[f"target_{p}" for p in pollutants]))
    return fit_quantiles(rows, list(FEATURES_72H), cells, trees, **options)


def predict_quantiles(models: QuantileModels, samples: DataFrame, monotone: bool = True, native: bool = False) -> DataFrame:
    """Adds `<pollutant>_p10/p50/p90`; ordered and non-negative unless told otherwise.

    `native` scores by plain expressions, for forecasts; the default, in Arrow batches, is for many rows.
    """
    from hazeline.operators.bands import monotone_quantiles

    names = {(c, q): f"{c.removeprefix('target_')}_p{round(q * 100)}" for c, q in models.cells}
    ordered = [names[cell] for cell in models.cells]
    out = samples.withColumns(dict(zip(ordered, models.columns()))) if native else models.transform(samples, ordered)
    triples = {c.removeprefix("target_"): tuple(names[c, q] for q in sorted(q for d, q in models.cells if d == c)) for c, _ in models.cells}
    return monotone_quantiles(out, triples) if monotone else out


def save_models(spark: SparkSession, models: QuantileModels, metadata: dict, path: str) -> None:
    """The models and one metadata document."""
    models.save(spark, f"{path}/models")
    spark.createDataFrame([(json.dumps({**metadata, "cells": models.cells}),)], "meta string").write.mode("overwrite").text(f"{path}/metadata")


def load_models(spark: SparkSession, path: str) -> tuple[QuantileModels, dict]:
    return QuantileModels.load(spark, f"{path}/models"), json.loads(spark.read.text(f"{path}/metadata").first()[0])
