"""Conversations as training examples: every assistant turn with all turns before it as context.

A turn becomes one segment `<|role|>text<|end|>`. Inside role and text a backslash is doubled and
`<`, `[` and `|` get one behind them, so no control string (of this template or of the bracketed and
angled ones) can come from a text, and the change can be undone.

Every example is written out in pieces, one row per turn of its context and one for the reply, so
that no row grows with the conversation; `render` joins the pieces where a conversation fits in a
task. Only the reply lies under the loss mask. DataFrame functions only, but for the digests of
conversations that are too long for a row. Positions come from `operators.ordered.place`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import bounded
from hazeline.operators.ordered import place

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
GUARDED = ("<", "[", "|")
#: Characters of a conversation that are put in one row to be hashed; longer ones are streamed.
IN_ROW = 1 << 20


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in GUARDED:
        out = F.replace(out, F.lit(c), F.lit(c + "\\"))
    return out


def unescape(text: Column) -> Column:
    for c in GUARDED:
        text = F.replace(text, F.lit(c + "\\"), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, start, stop, loss_start, loss_stop, example, first, replies, examples, total) per turn of (conv_id, turn, role, text).

    Positions count code points within the conversation's string. A null text or role is empty; equal
    turn numbers are ordered by role and text; a null conv_id is a conversation of its own. `example`
    numbers the assistant turns from 1 and is null elsewhere, as is the mask. `first` is the first
    example that holds the turn, `replies` the number of assistant turns, `examples` one more where
    turns follow the last reply, `total` the length of the conversation's string. No conversation has to fit in a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), F.concat(head, escape(text), F.lit(END)).alias("segment"),
        F.char_length(head).alias("_head"), (role == "assistant").cast("long").alias("_reply"))
    placed = place(rows, ["conv_id"], ["turn", "role", "segment"]).previous({"_before": "_reply"}).running({
        "stop": F.char_length("segment").cast("long"), "_replies": F.col("_reply"),
        "_ends": F.col("_reply") - F.coalesce("_before", F.lit(0))}).rows()  # adds up to whether the last turn is a reply
    start, reply = F.col("stop") - F.char_length("segment"), F.col("_reply") == 1
    return placed.select(
        "conv_id", "turn", "segment", start.alias("start"), "stop",
        F.when(reply, start + F.col("_head")).alias("loss_start"), F.when(reply, F.col("stop") - len(END)).alias("loss_stop"),
        F.when(reply, F.col("_replies")).alias("example"), (F.col("_replies") + 1 - F.col("_reply")).alias("first"),
        F.col("_replies_total").alias("replies"), (F.col("_replies_total") + 1 - F.col("_ends_total")).alias("examples"),
        F.col("stop_total").alias("total"))


def examples(parts: DataFrame) -> DataFrame:
    """(conv_id, example, final, turn, start, stop, text, loss_start, loss_stop, total): the pieces of every example of `segments`.

    An example is the texts of its pieces in the order of `start`: all turns before an assistant turn,
    and this reply, the only piece with a mask (positions in the example). Turns after the last reply make one more example without
    a mask (example null), so that every turn is in the `final` example of its conversation.
    """
    spread = parts.withColumn("_to", F.explode(F.sequence("first", "examples")))
    own = F.col("_to") == F.col("example")
    return spread.select(
        "conv_id", F.when(F.col("_to") <= F.col("replies"), F.col("_to")).alias("example"), (F.col("_to") == F.col("examples")).alias("final"),
        "turn", "start", "stop", F.col("segment").alias("text"), F.when(own, F.col("loss_start")).alias("loss_start"),
        F.when(own, F.col("loss_stop")).alias("loss_stop"), "total")


def render(pieces: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_stop): the `examples` as one string each, for conversations that fit in a task."""
    joined = pieces.groupBy("conv_id", "example").agg(
        F.array_sort(F.collect_list(F.struct("start", "text"))).alias("_all"), F.max("loss_start").alias("loss_start"), F.max("loss_stop").alias("loss_stop"))
    return joined.select("conv_id", "example", F.concat_ws("", F.transform("_all", lambda p: p["text"])).alias("text"), "loss_start", "loss_stop")


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, turn, stop, role, text, reply, total), decoded from the written `examples` alone.

    `role` and `text` are given once per turn, from the final example, `reply` once per assistant
    turn, from the mask of its own example; elsewhere they are null.
    """
    body = F.expr(f"substring(text, {len(OPEN) + 1}, char_length(text) - {len(OPEN) + len(END)})")
    cut = F.instr(body, CLOSE)
    masked = F.expr("substring(text, cast(loss_start - start + 1 AS int), cast(loss_stop - loss_start AS int))")
    return pieces.where("final OR loss_start IS NOT NULL").select(
        "conv_id", "turn", "stop", F.when(F.col("final"), unescape(F.substring(body, F.lit(1), cut - 1))).alias("role"),
        F.when(F.col("final"), unescape(F.substring(body, cut + len(CLOSE), F.char_length(body)))).alias("text"),
        F.when(F.col("loss_start").isNotNull(), unescape(masked)).alias("reply"), "total")


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of rows sorted by (conversation, stop); what is carried is one conversation's two hash states."""
    now, said, replies = None, hashlib.sha256(), hashlib.sha256()
    done = lambda: pd.DataFrame({"key": [now[0]], "turns_sha256": [said.hexdigest()], "loss_sha256": [replies.hexdigest()]})
    for pdf in batches:
        for key, turn, reply in zip(pdf["key"], pdf["said"], pdf["reply"]):
            if now != (key,):
                if now is not None:
                    yield done()
                now, said, replies = (key,), hashlib.sha256(), hashlib.sha256()
            if turn is not None:
                said.update(turn)
            if reply is not None:
                replies.update(reply)
    if now is not None:
        yield done()


def digests(turns: DataFrame, in_row: int = IN_ROW) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256) per conversation of `read_back`.

    The digests are of `role, newline, text, newline` of all turns, and of all replies. Conversations
    of up to `in_row` characters are hashed in a row. SHA-256 takes its input in order, so a longer one
    goes through one task, sorted (on disk where need be) and streamed, however long it is.
    """
    said = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    rows = turns.select("conv_id", "stop", said.alias("said"), "reply", "total")
    count, chars = F.count("said").alias("n_turns"), F.coalesce(F.sum(F.char_length("reply")), F.lit(0)).cast("long").alias("loss_chars")
    whole = rows.where(F.col("total") <= in_row).groupBy("conv_id").agg(
        count, chars, F.array_sort(F.collect_list(F.struct("stop", "said", "reply"))).alias("t"))
    joined = lambda name: F.concat_ws("", F.transform("t", lambda x: x[name]))
    columns = "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"
    out = whole.withColumns({"turns_sha256": F.sha2(joined("said"), 256), "loss_sha256": F.sha2(joined("reply"), 256)}).select(*columns)
    long = rows.where(F.col("total") > in_row)
    if bounded(long.select("total"), 0):
        return out
    sums = long.groupBy("conv_id").agg(count, chars).withColumn("key", F.col("conv_id").cast("string"))
    sent = long.select(F.col("conv_id").cast("string").alias("key"), "stop", F.col("said").cast("binary").alias("said"), F.col("reply").cast("binary").alias("reply"))
    hashed = sent.repartition("key").sortWithinPartitions("key", "stop").mapInPandas(_stream, "key string, turns_sha256 string, loss_sha256 string")
    met = sums.join(hashed.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")))
    return out.unionByName(met.select(*columns))
