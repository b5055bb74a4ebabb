"""Exact duplicates by a minimal perfect hash over historical distinct digests.

The index has two tables. `slots` holds a full digest and its winner at (shard, slot), as many
slots in a shard as it has digests. `shifts` holds, per (shard, bucket), the displacement that
sends the digests of the bucket to their slots. A lookup finds the bucket's displacement, from it
the only slot the digest can have, and compares the whole digest there.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import bounded, join_small
from hazeline.session import durable

#: Digests per shard and per bucket, on average.
SHARD, LOAD = 50_000, 4
BUCKETS = SHARD // LOAD


@dataclass(frozen=True)
class Index:
    slots: DataFrame  # shard, slot, digest, keep_id, group_size, ties
    shifts: DataFrame  # shard, bucket, shift, size
    shards: int


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _number(hexes: Column, start: int) -> Column:
    return F.conv(F.substring(hexes, start, 12), 16, 10).cast("long")


def _place(shards: int) -> dict[str, Column]:
    return {"shard": F.pmod(_number(F.col("digest"), 1), F.lit(shards)).cast("int"),
            "bucket": F.pmod(_number(F.col("digest"), 13), F.lit(BUCKETS)).cast("int")}


def _slot_of(key: int, shift: int, size: int) -> int:
    """As Spark's pmod(xxhash64(digest, shift), size), given xxhash64(digest)."""
    value = xxhash.xxh64_intdigest(struct.pack("<q", shift), key)
    return (value - (1 << 64) if value >> 63 else value) % size


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """Displacements of one shard: buckets by falling size; a lone digest takes any free slot (-slot - 1)."""
    size = len(pdf)
    keys = [xxhash.xxh64_intdigest(d.encode(), 42) for d in pdf["digest"]]
    buckets: dict[int, list[int]] = {}
    for key, bucket in zip(keys, pdf["bucket"].tolist()):
        buckets.setdefault(bucket, []).append(key)
    taken, shifts, free = bytearray(size), {}, 0
    for bucket, members in sorted(buckets.items(), key=lambda b: (-len(b[1]), b[0])):
        if len(members) == 1:
            while taken[free]:
                free += 1
            taken[free] = 1
            shifts[bucket] = -free - 1
            continue
        shift = 0
        while True:
            slots = {_slot_of(k, shift, size) for k in members}
            if len(slots) == len(members) and not any(taken[s] for s in slots):
                break
            shift += 1
        for s in slots:
            taken[s] = 1
        shifts[bucket] = shift
    return pd.DataFrame({"shard": pdf["shard"].iloc[0], "bucket": list(shifts), "shift": list(shifts.values()), "size": size})


def _slot() -> Column:
    return F.when(F.col("shift") < 0, -F.col("shift") - 1).otherwise(
        F.pmod(F.xxhash64("digest", "shift"), F.col("size"))).cast("long")


def group(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size, ties) of rows (id, digest): the largest id of a digest wins.

    Counted by (digest, id) first, and combined before each shuffle; `ties` is the number of rows
    that are equal to the winner. An id of null wins only where the group has no other.
    """
    once = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("digest").agg(
        F.max("id").alias("keep_id"), F.sum("n").alias("group_size"),
        F.max_by("n", F.struct(F.col("id").isNotNull(), "id")).alias("ties"))


def build_index(history: DataFrame) -> Index:
    """Index of historical groups (digest, keep_id, group_size, ties), one row per digest."""
    history = durable(history)
    shards = max(1, -(-history.count() // SHARD))
    keys = history.withColumns(_place(shards))
    shifts = durable(keys.select("shard", "bucket", "digest").groupBy("shard").applyInPandas(
        _build, "shard int, bucket int, shift long, size long"))
    slots = keys.join(shifts, ["shard", "bucket"]).withColumn("slot", _slot())
    return Index(durable(slots.select("shard", "slot", "digest", "keep_id", "group_size", "ties")), shifts, shards)


def lookup(rows: DataFrame, index: Index) -> DataFrame:
    """(id, digest, keep_id, group_size, ties) per row (id, digest); nulls where the digest is no member."""
    found = rows.withColumns(_place(index.shards)).join(index.shifts, ["shard", "bucket"], "left").withColumn("slot", _slot())
    held = index.slots.select("shard", "slot", F.col("digest").alias("held"), "keep_id", "group_size", "ties")
    joined = found.join(held, ["shard", "slot"], "left")
    same = F.col("digest") == F.col("held")
    return joined.select("id", "digest", *[F.when(same, F.col(c)).alias(c) for c in ("keep_id", "group_size", "ties")], same.alias("member"))


def find_duplicates(docs: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, keep_id, group_size, kept) per row; texts are equal when identical, null is empty.

    Without `index` the table is its own history: the index covers all its distinct digests, and the
    winner is the row with the largest id. With the index of earlier tables, members repeat a
    historical text and are not kept; the rest groups among itself. Rows equal in id and text are
    repeats of one document: all carry the same verdict here, `deduplicate` returns one of them.
    """
    own = index is None
    rows = durable(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")))
    index = build_index(group(rows)) if own else index
    looked = lookup(rows, index)
    members = looked.where("member").select(
        "id", "digest", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & F.lit(own)).alias("kept"))
    new = looked.where("member IS NULL OR NOT member").select("id", "digest")
    alone = new.join(group(new), "digest").select(
        "id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))
    return members.unionByName(alone)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns: the row with the largest id of each text.

    Every digest is looked up in the index of the table's repeated digests; only those repeats are
    joined to the rows with their texts (by broadcast where they are few).
    """
    rows = durable(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")))
    groups = durable(group(rows))
    index = build_index(groups.where("group_size > 1"))
    repeats = durable(lookup(groups.select(F.col("keep_id").alias("id"), "digest"), index).where("member").select(
        F.col("digest").alias("__digest"), "keep_id", "ties").withColumnRenamed("keep_id", "__keep").withColumnRenamed("ties", "__ties"))
    marked = join_small(docs.withColumn("__digest", digest(F.col(text_col))), repeats, "__digest")
    stay = marked.where(F.col("__ties").isNull() | F.col(id_col).eqNullSafe(F.col("__keep")))
    out = stay.where("__ties IS NULL OR __ties = 1")
    again = repeats.where("__ties > 1")
    if not bounded(again, 0):
        out = out.unionByName(stay.where("__ties > 1").dropDuplicates(["__digest"]))
    return out.select(*docs.columns)
