"""The corpus pipeline: documents in, packed token sequences out, one operator per stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm import decontaminate, exactdedup, packing, simhash, toxicity
from hazeline.llm.common import session, table
from hazeline.llm.queries import ACCEPT, TOKENIZER
from hazeline.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go; the score learns from the table's own labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model, score="__toxicity").where(F.col("__toxicity") < ACCEPT).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exactdedup.deduplicate(docs)


def drop_near_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash fingerprints (at most 4 of 64 bits apart, as in `op1_simhash`) the smallest id stays."""
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces: their ids (bytes, four an id), their sequence and place in it."""
    return packing.packed(docs, TOKENIZER).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_repeats), ("near_dedup", drop_near_repeats),
    ("decontamination", drop_benchmark), ("best_fit_packing", pack_sequences),
]

#: Learned scores and token ids have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    folder, docs = f"{shared_folder(session(spark))}/corpus-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(session(spark), docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
