"""A training corpus from `documents`: five stages, each written and read again as the next one's documents.

Every stage but the last returns the columns of its documents, extra ones included. Stages that decide by row (language ID,
toxicity, exact dedup) keep or reject each row by itself; near duplicates decide by id, so rows of one repeated id go or stay
together, and a null id always stays. Null and empty texts: language ID rejects them (no letter). Ties: the smallest id stays.
Very long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exact_dedup, language_id, ngram_join, packing, toxicity
from .queries import pattern, tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, least_score: float = 0.0) -> DataFrame:
    """Rejects documents without any language: no text, no letter in it, or a corrected share of known n-grams below
    `least_score` in every language. If nothing was learned, only letters decide."""
    found = language_id.identify(docs, common.crc_of_id() % 5 != 0, whole=True)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= least_score) | (F.col("lang_pred") == language_id.UNDETERMINED) & F.col("lettered")).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are more likely toxic than not."""
    return toxicity.grade_toxicity(docs, common.documents(spark, sf_dir, "labels"), whole=True).where("not toxic").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    kept = exact_dedup.group_copies(docs, keep="smallest").where("kept")
    return kept.select(*[F.col("norm").alias("text") if c == "text" else F.col("doc_id") if c == "doc_id" else F.col("row").getField(c).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays."""
    rejected = ngram_join.similar_groups(docs, width=5, percent=80).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), pattern())


STAGES = [("language_id", language), ("toxicity", toxic), ("exact_dedup", exact), ("near_duplicates", near), ("packing", pack)]
ORACLE_SQL = None  # SQL can't express the trained stages; the tests of stages and operators compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = common.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            common.remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
