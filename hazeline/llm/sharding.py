"""Weighted rendezvous hashing of record keys to shards. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.operators.ordered import place
from hazeline.session import durable

#: Hex digits of the hash that make the draw of a (key, shard) pair; 52 bits fit a double exactly.
DIGITS = 13


def score(key: Column, shard: Column, weight: Column) -> Column:
    """-weight / ln(u) with u in (0, 1) drawn from (key, shard): the best shard has the largest."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", key, shard.cast("string"))), 1, DIGITS), 16, 10).cast("double")
    return -weight / F.ln((draw + 0.5) / float(16 ** DIGITS))


def best(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, order) of the best of the shards from `first` on; a tie goes to the lowest shard."""
    shards = F.array(*[F.struct(F.lit(first + i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    return F.array_max(F.transform(shards, lambda s: F.struct(score(key, s["shard"], s["weight"]).alias("score"), (-s["shard"]).alias("order"))))


def assign(
    docs: DataFrame, weights: Sequence[float], grown: float = 1.0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) per row.

    The shard depends on the id and the weights alone; with one more shard of weight `grown` a row
    stays where it is or moves into the new one. A null id is a key like any other; equal ids meet
    in one shard. Slots count a shard's rows by (id, crc, arrival) without a gap; they are numbered
    by range placement, so no shard has to fit in a task. Null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"),
        best(key, weights).alias("_best"), score(key, F.lit(len(weights)), F.lit(float(grown))).alias("_new"),
    ).withColumns({
        "shard": (-F.col("_best.order")).cast("int"),
        "grown_shard": F.when(F.col("_new") > F.col("_best.score"), len(weights)).otherwise(-F.col("_best.order")).cast("int"),
    }).drop("_best", "_new")
    numbered = place(durable(rows), ["shard"], ["id", "text_crc32", "_row"]).running({"slot": F.lit(1)}).rows()
    return numbered.select("id", "size", "text_crc32", "shard", (F.col("slot") - 1).cast("long").alias("slot"), "grown_shard")
