"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bestfit, decontaminate, importance, jaccard, katz, lines, mixing, preferences, quality, rows, substrings, suffixes, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("file")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.drop("text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(_table(spark, sf_dir, "documents"), with_text=False)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.scan(docs, _table(spark, sf_dir, "benchmark"), clean=False).drop("text")


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are taken as the chosen and rejected of pair k."""
    turns = _table(spark, sf_dir, "conversations")
    return preferences.preference_pairs(turns, F.expr("conv_id div 2"), F.expr("conv_id % 2 = 0"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", "lang", mixing.lexical_topic(F.col("text")).alias("topic"), mixing.word_count(F.col("text")).alias("n_tokens"))
    d = mixing.mixed(docs)
    return d.withColumns({"weight": F.round("weight", 6), "probability": F.round("probability", 6)})


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    d = katz.katz_scores(_table(spark, sf_dir, "documents"), train)
    return d.withColumns({"base_score": F.round("base_score", 6), "score": F.round("score", 6)})


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated(_table(spark, sf_dir, "documents"), with_bytes=False)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bestfit.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_warc, op2_line_dedup, op3_quality_rules, op4_substring_dedup, op5_decontamination, op6_preferences, op7_mixing, op8_lm_scoring, op9_jaccard_join,
        op10_suffix_array_dedup, op11_best_fit_packing, op12_embedding_whitening, op13_importance_resampling,
    )
    return {f.__name__: f for f in every}
