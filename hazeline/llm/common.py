"""Shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.session import ready

#: ASCII letters only, as the query contracts ask; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def session(spark: SparkSession) -> SparkSession:
    """Settings for stages with Python workers: batches bounded by rows and by bytes, for very long texts.

    Row groups of 32 MB keep the Parquet writers of rows with whole texts or token ids small, zstd the tables between steps.
    """
    spark = ready(spark)
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    spark.conf.set("parquet.block.size", str(32 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def bounded(small: DataFrame, rows: int) -> bool:
    """Whether a (written, small) table has at most `rows` rows; counts one row more at most."""
    return small.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left", rows: int = 200_000) -> DataFrame:
    """Broadcast join behind a check of the table's size; beyond it an ordinary (skew-aware) join."""
    return big.join(F.broadcast(small) if bounded(small, rows) else small, on, how)


def regroup(pdfs: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The rows in the same order in frames of exactly `rows` rows, the last one shorter."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in pdfs:
        while len(pdf):
            part, pdf = pdf.iloc[:rows - size], pdf.iloc[rows - size:]
            held.append(part)
            size += len(part)
            if size == rows:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)
