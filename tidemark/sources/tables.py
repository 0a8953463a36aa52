"""The stored tables with their types: readers from Parquet and over JDBC, and the writer of articles."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import date_kst

#: Columns of each stored table; JSON lists are arrays.
SCHEMAS = {
    "sources": "source_id long, name string, url string, resolved_url string, symbol string, company string, category string, crawl_hour_kst int, crawl_interval_minutes int, max_pages int, window_hours int, is_active boolean, etag string, last_modified string, last_status string, last_error string, last_crawled_at timestamp, next_crawl_at timestamp, created_at timestamp, updated_at timestamp",
    "articles": "article_id long, source_id long, symbol string, title string, canonical_url string, excerpt string, published_at timestamp, content_hash string, sentiment string, sentiment_score int, materiality string, relevance int, event_type string, score_adjustment int, analysis_summary string, collected_at timestamp, insight_status string",
    "insights": "article_id long, summary string, keywords array<string>, sectors array<string>, evidence array<string>, sentiment string, sentiment_score int, materiality string, event_type string, impact_horizon string, market_view string, body_chars int, attempts int, engine string, model string, error string, created_at timestamp, updated_at timestamp",
    "symbols": "article_id long, symbol string, company string, market string, sector string, match_type string, mentions int, relevance int, created_at timestamp",
    "runs": "run_id long, source_id long, status string, fetched_count int, inserted_count int, error string, started_at timestamp, completed_at timestamp",
    "providers": "name string, priority int, is_active boolean, daily_limit int, used_today int, usage_date_kst date, cooldown_until timestamp, last_status string, success_count long, failure_count long",
}


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored table from Parquet files; columns that the files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_jdbc(spark: SparkSession, name: str, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A stored table from a database, read in parts by ranges of a numeric key; filters and columns are pushed down. Lists that the database holds as JSON text become arrays."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()
    return typed(rows, name)


def typed(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a stored table's columns and types: what is missing is null, lists may come as JSON text."""
    want = rows.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    have = dict(rows.dtypes)

    def column(field):
        kind = field.dataType.simpleString()
        c = F.col(field.name) if field.name in have else F.lit(None)
        return (F.from_json(c, kind) if kind.startswith("array") and have.get(field.name) == "string" else c.cast(kind)).alias(field.name)

    return rows.select(*[column(f) for f in want.fields])


def write_articles(articles: DataFrame, path: str, mode: str = "append") -> None:
    """Articles in folders by their day in Korea (of publication, else of collection), each day's rows in one task or as many as it needs."""
    day = date_kst(F.coalesce("published_at", "collected_at"))
    articles.withColumn("published_date_kst", day).repartition("published_date_kst", F.pmod(F.xxhash64("article_id"), F.lit(16))).write.mode(mode).partitionBy("published_date_kst").parquet(path)


def folder(spark: SparkSession) -> str:
    """A new folder in the one that the session names; a temporary one only for a session within one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: what is read several times is computed once, and a lost executor costs no recomputation. The folder is cleared after the job by whoever named it."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
