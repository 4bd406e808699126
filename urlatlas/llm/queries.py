"""The ten queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, exact_dedup, language_id, language_model, media_ts, ngram_join, packing, sharding, toxicity
from .common import crc_of_id, documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    awkward = "\\### Assistant: </turn> ok"
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", awkward), (-7, 1, "assistant", awkward)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(turns.unionByName(extra))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ': ', '\c'))
    + length(replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e'), ': ', '\c')) + 14 AS chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after
  FROM turns
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL AND after IS NOT DISTINCT FROM 'user'
    WHEN 'user' THEN (before IS NULL OR before IN ('system', 'assistant')) AND after IS NOT DISTINCT FROM 'assistant'
    WHEN 'assistant' THEN before IS NOT DISTINCT FROM 'user' ELSE false END) AS valid
FROM marked GROUP BY conv_id"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(documents(spark, sf_dir), width=3, percent=90)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), pattern())


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digest(documents(spark, sf_dir), tokenizer("byte_bpe_multi_50k.tiktoken"), pattern())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir), crc_of_id() % 5 != 1, tokenizer("byte_bpe_50k.tiktoken"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_of_id() % 5 == 0
    # the prediction is made from ids and texts; the id only says to which row it belongs
    return language_id.identify(docs, ~held_out).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.media_digest(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_exact_dedup, op3_ngram_jaccard_join, op4_packing, op5_byte_bpe, op6_sharding, op7_lm_scoring, op8_language_id, op9_media_columns, op10_toxicity, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op2_exact_dedup": OP2_SQL}
