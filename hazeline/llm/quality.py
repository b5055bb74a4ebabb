"""Text quality by a byte-level convolutional network, written and trained in numpy.

A byte is read together with its repetition level: how many of the bytes up to it repeat the text a
fixed distance (2 to 24 bytes) before it: 0, 8 or 16 and more. These 768 symbols have learned
vectors; learned filters run over `WIDTH` symbols; each filter is max-pooled in every chunk.
Chunks overlap and cover the whole document. The mean and the maximum of the chunk vectors give one
probability.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import utf8

SYMBOLS, VECTOR, WIDTH, FILTERS = 768, 8, 6, 16
CHUNK, STEP = 1024, 768
LAGS, GAP = range(2, 25), 32
BLOCK = 1 << 14
#: Chunks convolved at a time, so that one very long text stays bounded too.
GROUP = 512


@dataclass
class Network:
    vectors: np.ndarray  # SYMBOLS x VECTOR
    filters: np.ndarray  # WIDTH x VECTOR x FILTERS
    bias: np.ndarray  # FILTERS
    mean: np.ndarray  # FILTERS: weights of the mean over chunks
    top: np.ndarray  # FILTERS: weights of the maximum
    shift: np.ndarray  # one number

    def tables(self) -> np.ndarray:
        """What each symbol adds to each filter at each of the WIDTH places."""
        return np.ascontiguousarray(np.einsum("sv,wvf->wsf", self.vectors, self.filters), np.float32)


def start(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    return Network(
        rng.normal(0, 0.5, (SYMBOLS, VECTOR)), rng.normal(0, 0.3, (WIDTH, VECTOR, FILTERS)), np.zeros(FILTERS),
        rng.normal(0, 0.1, FILTERS), rng.normal(0, 0.1, FILTERS), np.zeros(1))


def symbols(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, where each text starts, lengths) with a gap of zero bytes before, between and behind texts."""
    gap = b"\0" * GAP
    data = np.frombuffer(gap + b"".join([t + gap for t in texts]), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = GAP + np.cumsum(lengths + GAP) - lengths - GAP
    long8, long16 = np.zeros(len(data), bool), np.zeros(len(data), bool)
    for lag in LAGS:
        run = data[lag:] == data[:-lag]
        for step in (1, 2, 4):
            run = run[step:] & run[:-step]
        if run.any():
            long8[lag + 7:] |= run
            long16[lag + 15:] |= run[8:] & run[:-8]
    code = data.astype(np.int16) + 256 * (long8.astype(np.int16) + long16)
    code[data == 0] = 0
    return code, starts, lengths


def chunks(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, document) of the overlapping chunks; every document has at least one."""
    count = 1 + np.maximum(0, -(-(lengths - CHUNK) // STEP))
    doc = np.repeat(np.arange(len(starts)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = starts[doc] + number * STEP
    return first, np.maximum(first + 1, np.minimum(first + CHUNK, starts[doc] + lengths[doc])), doc


def convolved(code: np.ndarray, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter outputs with the window starting at each symbol."""
    n = len(code)
    padded = np.concatenate([code, np.zeros(WIDTH, code.dtype)])
    out = np.empty((n, FILTERS), np.float32)
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        part = tables[0].take(padded[at:stop], axis=0)
        for place in range(1, WIDTH):
            part += tables[place].take(padded[at + place:stop + place], axis=0)
        out[at:stop] = part
    out += bias.astype(np.float32)
    return out


def _logit(net: Network, pooled: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(first, len(doc)))
    mean = np.add.reduceat(pooled, first, axis=0) / count[:, None]
    top = np.maximum.reduceat(pooled, first, axis=0)
    return mean @ net.mean + top @ net.top + net.shift[0], mean, top


def score(net: Network, texts: Sequence[bytes], budget: int = 1 << 20) -> np.ndarray:
    """Probabilities; texts are taken in groups of about `budget` bytes, and each stands alone."""
    tables, out, at = net.tables(), np.zeros(len(texts)), 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= budget):
            size += len(texts[stop])
            stop += 1
        out[at:stop] = _score(net, tables, texts[at:stop])
        at = stop
    return out


def _score(net: Network, tables: np.ndarray, texts: Sequence[bytes]) -> np.ndarray:
    code, starts, lengths = symbols(texts)
    first, last, doc = chunks(starts, lengths)
    pooled = np.empty((len(first), FILTERS))
    for at in range(0, len(first), GROUP):
        a, b = first[at:at + GROUP], last[at:at + GROUP]
        made = convolved(code[a[0]:b.max() + WIDTH], tables, net.bias)
        ends = np.stack([a, b], axis=1).ravel() - a[0]
        pooled[at:at + GROUP] = np.maximum.reduceat(made, ends, axis=0)[::2]
    logit, _, _ = _logit(net, np.maximum(pooled, 0), doc)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(texts: Sequence[bytes], labels: np.ndarray, prior: float, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the log loss; both classes weigh alike, then the bias is set to the `prior` of label 1.

    With labels of one class only (or none) the network gives the prior for every text.
    """
    net, rng = start(seed), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        net.mean[:], net.top[:] = 0, 0
        net.shift[:] = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
        return net
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    names = ("vectors", "filters", "bias", "mean", "top", "shift")
    m, v = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    step, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            grads = _gradients(net, [texts[i] for i in rows], labels[rows], weight[rows])
            step += 1
            pace = rate * (1 - step / (total + 1)) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for n in names:
                m[n] = 0.9 * m[n] + 0.1 * grads[n]
                v[n] = 0.999 * v[n] + 0.001 * grads[n] ** 2
                getattr(net, n)[...] -= pace * (m[n] / (np.sqrt(v[n]) + 1e-8))
    net.shift += np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    return net


def _gradients(net: Network, texts: Sequence[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    code, starts, lengths = symbols(texts)
    first, last, doc = chunks(starts, lengths)
    made = convolved(code, net.tables(), net.bias)
    peak = np.stack([a + made[a:b].argmax(axis=0) for a, b in zip(first, last)])  # chunk x filter: place of the maximum
    pooled = np.maximum(np.take_along_axis(made, peak, axis=0), 0).astype(np.float64)
    logit, mean, top = _logit(net, pooled, doc)
    error = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(texts)
    count = np.bincount(doc, minlength=len(texts))
    tops = pooled == top[doc]
    ties = np.add.reduceat(tops, np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), axis=0, dtype=np.int64)
    down = (error / count)[doc][:, None] * net.mean + np.where(tops, error[doc][:, None] * net.top / ties[doc], 0)
    down = np.where(pooled > 0, down, 0)
    padded = np.concatenate([code, np.zeros(WIDTH, code.dtype)])
    vectors, filters = np.zeros_like(net.vectors), np.zeros_like(net.filters)
    for place in range(WIDTH):
        seen = padded[peak + place]  # chunk x filter
        filters[place] = np.einsum("cfv,cf->vf", net.vectors[seen], down)
        np.add.at(vectors, seen.ravel(), (down[:, :, None] * net.filters[place].T[None]).reshape(-1, VECTOR))
    return {"vectors": vectors + 1e-5 * net.vectors, "filters": filters + 1e-5 * net.filters, "bias": down.sum(axis=0),
            "mean": mean.T @ error + 1e-4 * net.mean, "top": top.T @ error + 1e-4 * net.top, "shift": np.array([error.sum()])}


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into the held-out part; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(parts)) == part


def labelled(labels: DataFrame, label: str, parts: int, part: int, rows: int, per_class: bool) -> DataFrame:
    """At most `rows` training labels (id, label), picked by a hash of the id; per class where asked.

    Null labels are left out; an id with several labels takes the largest. The result is bounded, so
    it may be broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(label).cast("int").alias("label")).where(~held_out(F.col("id"), parts, part))
    order = F.xxhash64("id")
    if not per_class:
        return known.orderBy(order, "id").limit(rows)
    sides = [known.where(F.col("label") == c).orderBy(order, "id").limit(rows // 2) for c in (0, 1)]
    return sides[0].unionByName(sides[1])


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, rows: int = 4000, longest: int = 48 << 10) -> Network:
    """Train on a bounded sample: at most `rows` labelled rows outside the held-out part, half of each label.

    Only texts of at most `longest` bytes train, whole; repeated texts count once. The base rate of
    label 1 comes from all labels outside the held-out part.
    """
    outside = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), parts, part))
    prior = outside.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    sample = labelled(labels, "quality", parts, part, rows, True)
    text = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    got = text.join(F.broadcast(sample), "id").where(F.octet_length("text") <= longest).select("text", "label").distinct()
    found = sorted((r["label"], utf8(r["text"])) for r in got.collect())
    return train([t for _, t in found], np.array([y for y, _ in found], np.int64), 0.5 if prior is None else prior)


def quality(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row, from the whole text alone. A null text is empty; repeated rows stay.

    The network is some 60 KB and travels with the task.
    """
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(score(net, [utf8(t) for t in texts]))

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("score"))
