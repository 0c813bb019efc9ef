"""A corpus pipeline of five stages; each works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard, lines, mixing, quality, rows

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.quality_rules(docs).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents that have no line left.

    Rows with equal id and text get one result, so they are one row before.
    """
    keyed, names = rows.with_keys(docs)
    done = lines.dedup_lines(docs).filter("n_lines = 0 or n_removed < n_lines").dropDuplicates(list(rows.KEYS))
    done = done.select(*(F.col(k).alias(n) for k, n in zip(rows.KEYS, names, strict=True)), F.struct("n_removed", "kept_text").alias(f"done_{names[0]}"))
    kept = keyed.join(done, names).withColumn("text", F.col(f"done_{names[0]}.kept_text"))
    return kept.withColumn("n_chars", F.when(F.col(f"done_{names[0]}.n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, with the smallest id, or one without an id if none has one; texts without words all stay.

    Equal rows become one on their way to the join, in the task that reads them, so many of them do not meet.
    """
    found = jaccard.jaccard_components(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", *rows.KEYS)).alias("one")
    kept = found.filter("n_shingles > 0").groupBy("component_key").agg(first)
    has_word = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed, names = rows.with_keys(docs.filter(has_word))
    kept = kept.select(*(F.col(f"one.{k}").alias(n) for k, n in zip(rows.KEYS, names, strict=True)))
    return keyed.dropDuplicates(names).join(kept, names, "left_semi").select(*docs.columns).unionByName(docs.filter(~has_word))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    cleaned = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that tokens meet the target marginals of source, language and topic.

    Adds mix_topic, mix_tokens, weight and probability, which replace columns of these names.
    """
    d = docs.withColumns({"mix_topic": mixing.lexical_topic(F.col("text")), "mix_tokens": mixing.word_count(F.col("text"))})
    return mixing.mixed(d, powers=dict.fromkeys(("source", "lang", "mix_topic"), 0.5), tokens_col="mix_tokens").filter("taken").drop("taken")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing_sources),
]

#: Near duplicates and components are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is written and read again."""
    rows.small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = rows.written(docs, name.replace(" ", "-"))
    return docs
