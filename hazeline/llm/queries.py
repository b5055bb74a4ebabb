"""One registered query per operator, with the columns that its contract asks for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm import (
    chat, decontaminate, exactdedup, hardneg, htmltext, packing, periodic, quality, repetition, sharding, simhash, toxicity, urlfilter)
from hazeline.llm.common import table
from hazeline.llm.oracles import ORACLES  # noqa: F401
from hazeline.session import durable

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SHARDS = 40
ACCEPT = 0.7


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), TOKENIZER, ids=False).withColumnRenamed("id", "doc_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.zip_with("stops", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _judged(scored: DataFrame, parts: int, part: int) -> DataFrame:
    return scored.select(
        F.col("id").alias("doc_id"), quality.held_out(F.col("id"), parts, part).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(quality.quality(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 4, 2)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.find_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    written = durable(chat.examples(chat.segments(given.unionByName(probe))))
    chars = written.groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("formatted_chars"))
    read = chat.digests(chat.read_back(written))
    return read.join(chars, read["conv_id"].eqNullSafe(chars["conv_id"])).select(read["*"], "formatted_chars")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _judged(toxicity.toxicity(docs.select(F.col("doc_id").alias("id"), "text"), model), 3, 1)


def op11_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.judge(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "n_covered")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hardneg.mine(rows, F.col("id") % 100 == 0)


def with_periods(docs: DataFrame) -> DataFrame:
    """The texts with the repeated stretches that the contract plants: words from a on repeat the p words at a."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    placed = cut.where("n > 0").withColumn("a", (g % F.col("n")).cast("int")).withColumn(
        "p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest)), " ")
    return placed.select("doc_id", text.alias("text")).unionByName(cut.where("n IS NULL OR n <= 0").select("doc_id", "text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(with_periods(table(spark, sf_dir, "documents"))).withColumn("top", periodic.longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_url_filter, op3_best_fit_packing, op4_decontamination, op5_rendezvous_shards, op6_quality,
    op7_exact_dedup, op8_chat_format, op9_html_text, op10_toxicity, op11_repetition, op12_hard_negatives, op13_periodic_runs)}
