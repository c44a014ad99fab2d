"""A corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import decontaminate, packing, pii, simhash, toxicity
from tidepanel.llm.common import crc_mod, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose worst window is more likely toxic than not."""
    scored = toxicity.scored_rows(spark, docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return scored.filter("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component, that of the least id; rows without an id come last and count by their text."""
    return simhash.one_of_each(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item; rows count by their text, so that ids may repeat or lack."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("key"))
    leaks = decontaminate.find_leaks(spark, rows.select(F.col("key").alias("doc_id"), "row.text"), table(spark, sf_dir, "benchmark"))
    return rows.join(leaks.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in angle brackets in place of each span of personal data, and counts the characters anew."""
    masked = pii.mask_personal_data(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

# The toxicity model, the CRF and the order of best fit are beyond SQL; tests/llm/test_pipeline.py compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs
