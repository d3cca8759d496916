"""A corpus pipeline over ``documents``: five stages, each of one operator of ``lecturespark.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturespark.llm import decontaminate, language, line_dedup, mixing, near_dedup
from lecturespark.llm.shared import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that fit no learned language or mixture, go; a missing language is filled in.

    Without a labelled document, all documents with letters stay as they are.
    """
    return language.with_language(docs, language.fit_languages(docs), fitting=True)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; ``n_chars`` follows the text."""
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates the document of least id stays; equal rows are one."""
    return near_dedup.without_duplicates(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of ``benchmark`` occurs go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a row per document and epoch, the last one of a source cut at its budget and marked ``cut``."""
    return mixing.apply_mix(docs, mixing.mix_sources(docs), mark="cut")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontaminate", remove_leaks),
    ("mix_sources", mix),
]

# Language models, edit distances and set similarity are out of SQL's reach; tests/llm has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if at == 0 else stored(docs), sf_dir)
    return docs
