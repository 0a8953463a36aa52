"""Corpus pipeline: language, common lines, near duplicates, mixture, packing, each over all that the stage before kept.

SQL can't express the language model, the weighted sampling and the tokens, so ORACLE_SQL is None; tests/llm compares a small run with a plain version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.language import only_accepted
from tidemark.llm.line_dedup import drop_common_lines
from tidemark.llm.mixing import mixed
from tidemark.llm.near_dedup import one_of_each
from tidemark.llm.packing import pack_documents
from tidemark.llm.shared import saved

ORACLE_SQL = None


def counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with the columns of like, n_chars (if there is one) counted anew."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure enough; those without letters (null and empty texts too) go. Null ids and repeated rows are rows like any other; other columns, whatever their names, are kept."""
    return only_accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds; those left without text go, those that had none stay. Of rows with one id each keeps its lines."""
    kept = drop_common_lines(docs).where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return counted(kept, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id; rows without id all stay, of rows with one id the first by text. Texts are compared whole, however long."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as it reads them, in the order of its schedule; those without words go. A null source is a source of its own; ties and repeated rows are told apart by a hash of the row."""
    return counted(mixed(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences; null ids, repeated rows and very long texts are packed like any other."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
