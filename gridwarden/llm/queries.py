"""The queries that __spark_entry__ registers for this subpackage, each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, language_id, line_dedup, minhash, mixing, oracle, packing, quality_classifier, quality_rules, suffix_dedup, toxicity
from .common import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_gone", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.host_rules(documents(spark, sf_dir), keep=["doc_id", "source"])
    return judged.select("doc_id", "source", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], F.round("rules.host_rate", 6).alias("host_rate"), "rules.kept")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.fit(documents(spark, sf_dir))
    return language_id.identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    return quality_classifier.classify(docs, labels(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return toxicity.classify(docs, labels(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def queries() -> dict:
    own = (op1_mix_sources, op2_line_dedup, op3_best_fit_packing, op4_nearest_neighbours, op5_quality_rules, op6_minhash_near_dedup, op7_language_id, op8_quality_classifier, op9_toxicity, op10_suffix_array_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Trained models, packings and fuzzy lines aren't expressed in SQL; tests/llm holds them against brute force."""
    return {"op1_mix_sources": oracle.MIX_SOURCES, "op5_quality_rules": oracle.QUALITY_RULES, "op6_minhash_near_dedup": oracle.NEAR_DUPLICATES, "op10_suffix_array_dedup": oracle.REPEATED_STRINGS}
