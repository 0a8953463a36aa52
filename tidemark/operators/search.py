"""Search by inverted indexes that are stored beside a table: of exact keywords, and of trigrams for any part of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an index; a term stands in one of them.
BUCKETS = 64
#: Parts that a folder's rows are dealt to, by article.
SHARES = 16
GRAM = 3


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    """A term's folder."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(postings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Stores (term, article_id) under folders by the term's hash, sorted by term.

    One shuffle, by folder and a hash of the article, so a term that most articles hold is spread over SHARES tasks; repeated rows meet in one and go there. Within a file row groups are told apart by term.
    """
    share = F.pmod(F.xxhash64("article_id"), F.lit(SHARES)).cast("int")
    rows = postings.select(bucket_of(F.col("term"), buckets).alias("bucket"), share.alias("share"), "term", "article_id").where("term is not null and article_id is not null")
    rows = rows.repartition("bucket", "share").dropDuplicates(["bucket", "share", "term", "article_id"])
    rows.sortWithinPartitions("bucket", "term", "article_id").drop("share").write.mode("overwrite").partitionBy("bucket").parquet(path)


def keyword_postings(rows: DataFrame, column: str) -> DataFrame:
    """(term, article_id) of rows whose column is a list of keywords."""
    return rows.select("article_id", F.explode(column).alias("term"))


def grams(texts: Column) -> Column:
    """The distinct trigrams of a list of texts, without case; a trigram lies within one of them."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.array(sorted({t[i : i + GRAM] for t in ts if t for i in range(len(t) - GRAM + 1)}), dtype=object) for ts in batch], dtype=object)

    return run(F.transform(texts, lambda t: F.lower(t)))


def text_postings(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(term, article_id) of the trigrams of rows' texts, whole texts being read."""
    return rows.select("article_id", F.explode(grams(F.array(*columns))).alias("term"))


def holding(spark: SparkSession, path: str, terms: list[str], schema: str = "article_id long", buckets: int = BUCKETS) -> DataFrame:
    """(article_id) of what holds all of some terms: only the folders of these are read, and in them the row groups that may hold the terms."""
    terms = sorted(set(terms))
    folders = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"), buckets)).distinct().collect()]
    index = spark.read.schema(f"term string, {schema}, bucket int").parquet(path)
    found = index.where(F.col("bucket").isin(folders) & F.col("term").isin(terms))
    return found.groupBy("article_id").agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select("article_id")


def search_keyword(rows: DataFrame, path: str, keyword: str, **how) -> DataFrame:
    """Rows whose list of keywords holds one exactly, by the index of write_index over keyword_postings."""
    return rows.join(holding(rows.sparkSession, path, [keyword], **how), "article_id", "left_semi")


def search_text(rows: DataFrame, columns: list[str], path: str, part: str, **how) -> DataFrame:
    """Rows one of whose texts holds a part, without case, by the index of write_index over text_postings: what holds all of its trigrams is looked at, and then kept if it holds the part.

    A part of fewer than three characters is looked for in all rows.
    """
    low = part.lower()
    asked = [low[i : i + GRAM] for i in range(len(low) - GRAM + 1)]
    found = rows.join(holding(rows.sparkSession, path, asked, **how), "article_id", "left_semi") if asked else rows
    held = F.lit(False)
    for c in columns:
        held = held | F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
    return found.where(held)
