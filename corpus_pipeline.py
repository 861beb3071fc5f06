"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Cases that all stages define alike: null ids stay null and are ids like others where rows are told apart; null texts count as empty ones;
texts of any length are used whole; an empty table gives an empty table; columns beside those of documents are carried by
all stages but the last, whatever their names. What a stage does beyond that stands in its docstring.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import line_dedup, mixing, ngram_join, quality, spm_dropout
from quillgraph.llm.common import checkpoint_dir, table


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half go.

    Rows with equal texts stay or go together, empty texts by the score of an empty text; without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which no word is left by that.

    Rows equal in id and text are treated alike; texts without words stay as they are. n_chars is counted anew."""
    out = line_dedup.dedup_lines(docs, removed="__gone")
    return _sized(out.filter((F.col("__gone") == 0) | (F.regexp_count("text", F.lit(r"\S")) > 0)).drop("__gone"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (sets of five words, Jaccard 0.8) stays, the one with the least id.

    Of rows equal in id and text one stays; texts without words are near nothing and all stay; a group without ids keeps one row."""
    return ngram_join.keep_one(docs, n=5, num=4, den=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    A null source is a source of its own. Rows equal in id, source and text share their copies evenly; texts without words are taken by
    their rate, rounded, and count nothing."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text; the copies that the mix makes of a document are segmented apart.

    Rows equal in id and text count as copies of each other: which of them gets which number is the same in the result. Empty texts
    have no ids."""
    w = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1))
    rows = docs.select("doc_id", "text").withColumn("copy", F.row_number().over(w))
    return spm_dropout.segmented(rows, copy="copy").select("doc_id", "n_ids", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece", sentencepiece),
]

#: A classifier, a similarity join and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; intermediate tables go to the shared checkpoint folder."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
