"""A pipeline over documents: quality classifier, line dedup, near-duplicate dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.llm import line_dedup, minhash, mixing, packing, quality_classifier
from gridwarden.llm.common import stored
from gridwarden.llm.queries import labels, tokenizer_path

#: No SQL: a trained classifier, hash signatures and packing aren't expressed in it. tests/llm holds brute-force versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is fitted on labels of the same folder."""
    judged = quality_classifier.classify(docs, labels(spark, sf_dir))
    return judged.where(F.col("predicted") == 1).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents that lose every line with a word go. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    left = out.where((F.col("n_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_gone") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id."""
    gone = stored(minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id"), "pipeline-duplicates")
    return docs.join(minhash.bounded_ids(gone), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: repeated documents as repeated rows, the one at a source's cut with its first words only."""
    out = mixing.apply_mix(mixing.mix(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
