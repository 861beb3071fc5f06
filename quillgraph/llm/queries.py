"""One query for each operator, over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, filter_audit, html_wrappers, kneser_ney, line_dedup, media_ts, mixing, ngram_join, prefix_trie, quality, sharding, spm_dropout
from .common import table
from .sql import SQL


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: shards differ by one row at most."""
    placed = sharding.shard_table(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.media_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="removed_lines")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_dropout.segmented(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_ids", "ids")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.main_texts(table(spark, sf_dir, "pages"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql(f"SELECT -1L conv_id, 0L turn, 'user' role, '{hard}' text UNION ALL SELECT -1L, 1L, 'assistant', '{hard}'")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.scores(table(spark, sf_dir, "documents"))


# columns of the operators' results that SQL can express, where it can't express all


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: sizes."""
    return op1_sharding(spark, sf_dir).select("doc_id", "size")


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: documents of each shard, and the slots that they fill without gaps."""
    return op1_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("docs"), (F.max("slot") - F.min("slot") + 1).alias("slots"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: payloads as read back."""
    return op2_media_ts(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: targets, and whether the words taken meet them to a hundredth (or a mean document, in small sources) and no document exceeds twice its size."""
    of = op3_mixing(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    by = of.groupBy("source").agg(F.count("*").alias("docs"), F.first("source_size").alias("source_size"), F.first("target").alias("t"), F.sum("taken").alias("taken"), F.avg("size").alias("mean"), F.every(F.col("taken") <= 2 * F.col("size")).alias("held"))
    return by.select("source", "docs", "source_size", F.round("t", 3).alias("target"), (F.col("held") & (F.abs(F.col("taken") - F.col("t")) <= F.greatest(0.01 * F.col("t"), F.col("mean")))).alias("met"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all but the model's score; the unigram score by its first four decimals."""
    return op13_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_sharding, op2_media_ts, op3_mixing, op4_line_dedup, op5_sentencepiece, op6_html, op7_ann, op8_chat_formatting, op9_quality, op10_ngram_join, op11_filter_audit, op12_prefix_trie, op13_lm_scoring)
    return {f.__name__: f for f in (*operators, shard_sizes, shard_counts, media_payloads, mix_targets, lm_base_scores)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
