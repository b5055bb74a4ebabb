"""Near-duplicates by the exact Jaccard similarity of word shingles.

Candidates come from 150 minimum hashes in `BANDS` bands of `ROWS`: two texts of similarity s share no
band with probability (1 - s**5)**30, 7e-6 at 0.8. Two sketches of the hashes then sort out pairs of
about 0.7 and less before any text is read: one bit of each hash travels with the bands, and pairs more
than `FAR` bits apart are dropped (at 0.8 the mean is 15; more than 36 have a probability of about 1e-7);
one byte of each hash is joined to the pairs that are left, of which `SAME` bytes must agree (at 0.8 the
mean is 120; fewer than 94 have a probability of about 3e-7, while 99 % of pairs at 0.53 fall away). What
remains and may join two groups is compared on its words, so no pair below the threshold links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import LOWER_BYTES, bounded, join_small, utf8
from hazeline.llm.components import components
from hazeline.session import durable

SEED = 42
BANDS, ROWS, FAR, SAME = 30, 5, 36, 94
CHUNK = 1024
_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
_TIMES, _PLUS = (_DRAWN[0] | np.uint64(1))[:, None], _DRAWN[1][:, None]
_POWER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(LOWER_BYTES).split()


def shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """Distinct shingles; a shorter text is one shingle, a text without words has none."""
    words = words_of(text)
    n = min(size, len(words))
    return set(zip(*[words[i:] for i in range(n)]))


def jaccard(a: str | None, b: str | None, size: int = 5) -> float:
    """Similarity of the shingle sets; 1 for two texts without words."""
    x, y = shingles(a, size), shingles(b, size)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def signature_of(text: str | None, size: int = 5) -> tuple[bytes, np.ndarray, int, int, int, bytes]:
    """(128-bit hash of the words, band keys, the bit sketch in three signed numbers, the byte sketch)."""
    words = words_of(text)
    node = xxhash.xxh3_128_digest(b" ".join(words), SEED)
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    n = min(size, len(words))
    rolled = np.zeros(len(words) - n + 1 if n else 0, np.uint64)
    for i in range(n):
        rolled = rolled * _POWER + hashes[i:i + len(rolled)]
    rolled = _mixed(rolled)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(rolled), CHUNK):
        np.minimum(low, (rolled[at:at + CHUNK] * _TIMES + _PLUS).min(axis=1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = _mixed(key * _POWER + column)
    wide = (low >> np.uint64(13)).astype(np.uint8)
    bits = np.frombuffer(np.packbits(wide & 1).tobytes() + bytes(24 - BANDS * ROWS // 8 - 1), "<i8").tolist()
    return node, key.view(np.int64), *bits, wide.tobytes()


def signature(text: Column, size: int = 5) -> Column:
    @F.pandas_udf("node binary, keys array<long>, b0 long, b1 long, b2 long, wide binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signature_of(t, size) for t in texts], columns=["node", "keys", "b0", "b1", "b2", "wide"])

    return of(text)


def _sides(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    one = nodes.select(F.col("n").alias("a"), F.col(column).alias("one"))
    two = nodes.select(F.col("n").alias("b"), F.col(column).alias("two"))
    return pairs.join(one, "a").join(two, "b")


def close(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose byte sketches agree often enough; written, as only these are compared on their texts."""
    @F.pandas_udf("boolean")
    def agree(one: pd.Series, two: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) if len(s) else np.zeros((0, 1)) for s in (one, two))
        return pd.Series((x == y).sum(axis=1) >= SAME)

    return durable(_sides(pairs, nodes, "wide").where(agree("one", "two")).select("a", "b"))


def alike(nodes: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, compared on the words."""
    @F.pandas_udf("boolean")
    def enough(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y, size) >= similarity - 1e-12 for x, y in zip(one, two)], dtype=bool)

    return _sides(close(nodes, pairs), nodes, "text").where(enough("one", "two")).select("a", "b")


def _near(x: Column, y: Column) -> Column:
    return sum(F.bit_count(x[b].bitwiseXOR(y[b])) for b in ("b0", "b1", "b2")) <= FAR


def links(nodes: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Links (a, b) between distinct texts (n, text, keys, b0, b1, b2, wide), with the components of all similar pairs.

    First every text meets one text of each of its bands, drawn by a hash of (band, text): in a large group
    of copies that is another one per band, so the group mostly hangs together after this step, at a cost of
    at most one pair per text and band. What is still in different components meets within its bands: all
    but the most frequent component of a band against everything there. Where many texts share most of
    their words and are no copies, these pairs grow with the square of their number; only those that the
    sketches let pass are compared on their texts. Only bands that texts share go on.
    """
    rows = nodes.select(F.explode("keys").alias("key"), "n", F.struct("b0", "b1", "b2").alias("bits"))
    drawn = F.struct(F.xxhash64("key", "n").alias("draw"), "n")
    ends = rows.groupBy("key").agg(F.min(drawn)["n"].alias("m"), F.min("n").alias("first"), F.max("n").alias("final"))
    shared = durable(rows.join(ends.where("first <> final").select("key", "m"), "key"))
    met = shared.select("n", "m").where("n <> m")
    tried = durable(met.select(F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b")).distinct())
    first = durable(alike(nodes, tried, size, similarity))

    found = components(first).select(F.col("node").alias("n"), F.col("component").alias("label"))
    rows = shared.drop("m").join(found, "n", "left").withColumn("label", F.coalesce("label", "n"))
    labels = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(
        F.max(F.struct("size", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    rows = durable(rows.join(labels.select("key", F.col("most.label").alias("most")), "key"))
    others = rows.where("label <> most").select("key", F.col("n").alias("m"), F.col("bits").alias("other_bits"), F.col("label").alias("other"))
    apart = (F.col("label") != F.col("other")) & ((F.col("label") == F.col("most")) | (F.col("n") < F.col("m")))
    pairs = rows.join(others, "key").where(apart & _near(F.col("bits"), F.col("other_bits")))
    pairs = pairs.select(F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b")).distinct()
    return first.unionByName(durable(alike(nodes, pairs.join(tried, ["a", "b"], "left_anti"), size, similarity)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` that stay, all columns: of each component of similar texts the one with the smallest id.

    Texts without words are copies of each other. A row without an id stays only if no row of its
    component has one. Rows equal in id and words are repeats of one document, of which one stays.
    Words equal in a 128-bit hash are one text, numbered once. Only the rows to drop are joined to the
    table; its columns stay in one struct on the way, so their names clash with nothing.
    """
    marked = durable(docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), signature(F.col(text_col), size).alias("sig")))
    text = F.col("row").getField(text_col)
    nodes = marked.groupBy("sig.node").agg(F.min_by(
        F.struct(text.alias("text"), "sig.keys", "sig.b0", "sig.b1", "sig.b2", "sig.wide"), F.coalesce("id", F.lit(0))).alias("first"))
    nodes = durable(nodes.select("node", "first.*").withColumn("n", F.monotonically_increasing_id()))
    found = components(links(nodes, size, similarity)).select(F.col("node").alias("n"), "component")
    rows = marked.groupBy("id", "sig.node").agg(F.count(F.lit(1)).alias("copies"))
    rows = durable(rows.join(nodes.select("node", "n"), "node").join(found, "n", "left").withColumn("component", F.coalesce("component", "n")))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "n")
    best = rows.groupBy("component").agg(F.min(rank).alias("best"))
    stays = rank == F.col("best")
    odd = durable(rows.join(best, "component").where(~stays | (F.col("copies") > 1)).select(
        F.col("id").alias("odd_id"), F.col("node").alias("odd_node"), stays.alias("again")))
    joined = join_small(marked, odd, F.col("id").eqNullSafe(F.col("odd_id")) & (F.col("sig.node") == F.col("odd_node")))
    out = joined.where("again IS NULL").select("row.*")
    if not bounded(odd.where("again"), 0):
        out = out.unionByName(joined.where("again").withColumn("node", F.col("sig.node")).dropDuplicates(["id", "node"]).select("row.*"))
    return out
