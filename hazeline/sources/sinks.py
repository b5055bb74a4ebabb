"""Writers of processed tables, archives and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.session import shared_folder
from hazeline.sources.readers import merge_archive


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_hourly(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Processed hourly table, one folder per year, rows of a station together and in order."""
    out = df.withColumn("year", F.year("ts"))
    # Range placement splits a station that is much larger than the others over several files.
    out.repartitionByRange("year", "station", "ts").sortWithinPartitions("year", "station", "ts").write.mode(
        mode).partitionBy("year").parquet(path)


def write_cycle(cycle: DataFrame, path: str, save_format: str = "parquet") -> None:
    """Append one forecast cycle; partitions by issue date let later reads prune."""
    cycle.withColumn("issue_date", F.to_date("issue_time")).write.mode("append").partitionBy("issue_date").format(
        save_format).save(path)


def append_observations(spark: SparkSession, new: DataFrame, path: str, keys=("station", "ts")) -> DataFrame:
    """Append only rows whose key is not archived yet; the archived row always wins.

    New rows are de-duplicated among themselves first, then anti-joined: the archive is
    never rewritten.
    """
    fresh = merge_archive(new.limit(0), new, list(keys))
    try:
        existing = spark.read.parquet(path).select(*keys)
    except Exception as ex:
        if "PATH_NOT_FOUND" not in str(ex):
            raise
        existing = None
    if existing is not None:
        fresh = fresh.join(existing, list(keys), "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def write_documents(docs: DataFrame, path: str) -> None:
    """One JSON document per line below `documents/`, null fields kept, ordered by issue and station inside
    files; then a manifest of the schema and the issues, which marks the documents as complete."""
    docs = docs.withColumn("issue_time", F.col("issue_time").cast("timestamp_ntz"))
    docs.repartitionByRange("issue_time", "station").sortWithinPartitions("issue_time", "station").write.mode(
        "overwrite").option("ignoreNullFields", "false").json(f"{path}/documents")
    written = docs.sparkSession.read.schema("issue_time timestamp_ntz, station string").json(f"{path}/documents")
    issues = written.groupBy("issue_time").agg(F.count(F.lit(1)).alias("n_documents"))
    issues.withColumn("schema", F.lit(docs.schema.json())).write.mode("overwrite").parquet(f"{path}/manifest")


def write_station_files(df: DataFrame, path: str, columns: dict[str, str], file: Column | None = None) -> None:
    """Raw-style station CSV files below `path`, with the given headers and NA for missing; with `file` in
    one folder `file=<name>` per file name, which holds one file however many tasks had its rows."""
    cols = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp")]
    cols += [F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(h) for c, h in columns.items()]
    if file is None:
        df.select(*cols).write.mode("append").option("header", True).csv(path)
    else:
        rows = df.select(*cols, file.alias("file")).repartition("file")
        rows.write.mode("append").option("header", True).partitionBy("file").csv(path)
