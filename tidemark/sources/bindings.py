"""The standard tables read as the library's logical tables, and the same as SQL.

Everything that the standard tables lack (status, sentiment, symbols) is derived from their keys, so the logical tables grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, dealt out to all of them, for work that is heavy for its rows; one of more splits is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: the first line is the title, the rest the body; ids give times and states."""
    k = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    title = F.split_part(text, F.lit("\n"), F.lit(1))
    published = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=(k % 43200).cast("int"))
    return table(spark, sf_dir, "documents").select(
        k.alias("article_id"),
        F.col("source").alias("source_id"),
        F.concat(F.lit("S"), (k % 50).cast("string")).alias("symbol"),
        title.alias("title"),
        F.substring(text, F.length(title) + 2, F.length(text)).alias("body"),
        F.substring(text, F.length(title) + 2, F.lit(200)).alias("excerpt"),
        F.when(k % 17 != 0, published).alias("published_at"),
        (published + F.expr("INTERVAL 5 MINUTES")).alias("collected_at"),
        F.when(k % 5 < 2, "긍정").when(k % 5 == 2, "부정").otherwise("중립").alias("sentiment"),
        (k * 7 % 101).cast("int").alias("sentiment_score"),
        F.when(k % 7 == 0, "높음").when(k % 7 < 3, "보통").otherwise("낮음").alias("materiality"),
        F.when(k % 4 == 0, "대기").when(k % 9 == 5, "오류").otherwise("완료").alias("insight_status"),
    )


ARTICLES = """articles AS (
  SELECT doc_id AS article_id, source AS source_id, 'S' || (doc_id % 50) AS symbol, split_part(coalesce(text, ''), chr(10), 1) AS title,
    substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) AS body,
    substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2, 200) AS excerpt,
    CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id % 43200) END AS published_at,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id % 43200 + 5) AS collected_at,
    CASE WHEN doc_id % 5 < 2 THEN '긍정' WHEN doc_id % 5 = 2 THEN '부정' ELSE '중립' END AS sentiment,
    (doc_id * 7 % 101)::INT AS sentiment_score,
    CASE WHEN doc_id % 7 = 0 THEN '높음' WHEN doc_id % 7 < 3 THEN '보통' ELSE '낮음' END AS materiality,
    CASE WHEN doc_id % 4 = 0 THEN '대기' WHEN doc_id % 9 = 5 THEN '오류' ELSE '완료' END AS insight_status
  FROM documents)"""


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has been found in analysed articles."""
    a = articles(spark, sf_dir).where("insight_status = '완료'")
    words = F.slice(F.array_distinct(F.split(F.lower("title"), " ")), 1, 8)
    return a.select("article_id", F.substring("body", 1, 100).alias("summary"), words.alias("keywords"), F.when(F.col("article_id") % 3 == 0, "rule").otherwise("llm").alias("engine"), "sentiment_score")


INSIGHTS = """insights AS (
  SELECT article_id, substr(body, 1, 100) AS summary, string_split(lower(title), ' ') AS words,
    CASE WHEN article_id % 3 = 0 THEN 'rule' ELSE 'llm' END AS engine, sentiment_score
  FROM articles WHERE insight_status = '완료')"""


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which article mentions which symbol."""
    a = articles(spark, sf_dir)
    one = a.select("article_id", "symbol")
    two = a.where("article_id % 2 = 0").select("article_id", F.concat(F.lit("S"), (F.col("article_id") % 7 + 60).cast("string")).alias("symbol"))
    rows = one.unionByName(two)
    return rows.select("article_id", "symbol", F.concat(F.lit("Company "), "symbol").alias("company"), (F.col("article_id") % 4 + 1).cast("int").alias("mentions"))


BRIDGE = """bridge AS (
  SELECT article_id, symbol, 'Company ' || symbol AS company, (article_id % 4 + 1)::INT AS mentions FROM (
    SELECT article_id, symbol FROM articles UNION ALL SELECT article_id, 'S' || (article_id % 7 + 60) FROM articles WHERE article_id % 2 = 0))"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as sources: one is due every hour."""
    k = F.col("n_nationkey")
    due = F.to_timestamp(F.lit("2024-01-15 00:00:00")) + F.make_dt_interval(hours=(k * 7 % 25).cast("int"))
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("source_id"), F.col("n_name").alias("name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("category"), (k % 6 != 5).alias("is_active"), due.alias("next_crawl_at"))


SOURCES = """sources AS (
  SELECT n_nationkey::BIGINT AS source_id, n_name AS name, 'R' || n_regionkey AS category, n_nationkey % 6 <> 5 AS is_active,
    TIMESTAMP '2024-01-15' + to_hours(n_nationkey * 7 % 25) AS next_crawl_at FROM nation)"""


def publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of documents, with when each is due: a few hours before or after its latest article."""
    a = articles(spark, sf_dir).groupBy("source_id").agg(F.max("article_id").alias("k"), F.max("collected_at").alias("at"))
    return a.select("source_id", F.concat(F.lit("Source "), "source_id").alias("name"), (F.col("k") % 6 != 5).alias("is_active"), (F.col("at") + F.make_dt_interval(hours=(F.col("k") % 25 - 12).cast("int"))).alias("next_crawl_at"))


PUBLISHERS = """publishers AS (
  SELECT source_id, 'Source ' || source_id AS name, max(article_id) % 6 <> 5 AS is_active, max(collected_at) + to_hours(max(article_id) % 25 - 12) AS next_crawl_at FROM articles GROUP BY 1)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as crawl runs."""
    k = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        k.alias("run_id"),
        (F.col("o_custkey") % 25).alias("source_id"),
        F.when(F.col("o_orderstatus") == "F", "완료").when(F.col("o_orderstatus") == "O", "오류").otherwise("실행 중").alias("status"),
        (k % 200).cast("int").alias("fetched_count"),
        (k % 40).cast("int").alias("inserted_count"),
        start.alias("started_at"),
        F.when(F.col("o_orderstatus") != "P", start + F.make_dt_interval(mins=(k % 90).cast("int"))).alias("completed_at"),
    )


RUNS = """runs AS (
  SELECT o_orderkey AS run_id, o_custkey % 25 AS source_id, CASE o_orderstatus WHEN 'F' THEN '완료' WHEN 'O' THEN '오류' ELSE '실행 중' END AS status,
    (o_orderkey % 200)::INT AS fetched_count, (o_orderkey % 40)::INT AS inserted_count, o_orderdate::TIMESTAMP AS started_at,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::TIMESTAMP + to_minutes(o_orderkey % 90) END AS completed_at FROM orders)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored news of a symbol."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("article_id"),
        F.col("user_id").cast("string").alias("symbol"),
        F.col("ts").cast("timestamp").alias("published_at"),
        F.when(kind.isin("purchase", "signup"), "긍정").when(kind == "error", "부정").otherwise("중립").alias("sentiment"),
        F.when(kind != "view", F.least(F.lit(100.0), F.col("value"))).alias("score"),
    )


MENTIONS = """mentions AS (
  SELECT event_id AS article_id, user_id::VARCHAR AS symbol, ts::TIMESTAMP AS published_at,
    CASE WHEN event_type IN ('purchase', 'signup') THEN '긍정' WHEN event_type = 'error' THEN '부정' ELSE '중립' END AS sentiment,
    CASE WHEN event_type <> 'view' THEN least(100.0, value) END AS score FROM events)"""

#: Bars of a year, to which a9 alone is cut; what a bar's volume stands for (the tables' turnover is far below any curve of liquidity).
BARS, VOLUME = 252, 1000.0


def bars(spark: SparkSession, sf_dir: str, limit: int | None = None, volume_scale: float = VOLUME) -> DataFrame:
    """lineitem as daily bars of suppliers: the price of a line is its price by its quantity; the latest `limit` bars of each (null: all). Lines are ordered by one number, so that Spark aggregates them by hash, without a sort."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("nth"))
    out = line.groupBy("symbol", "date").agg(F.min_by("p", "nth").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "nth").alias("close"), (F.sum("l_quantity") * volume_scale).alias("volume"))
    if limit is None:
        return out
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return out.withColumn("n", n).where(F.col("n") <= limit).drop("n")


BARS_SQL = f"""all_bars AS (
  SELECT l_suppkey::VARCHAR AS symbol, l_shipdate::DATE AS date, min_by(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, max_by(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS close,
    sum(l_quantity) * {VOLUME} AS volume FROM lineitem GROUP BY 1, 2),
bars AS (SELECT * FROM all_bars)"""
YEAR_SQL = BARS_SQL.replace("(SELECT * FROM all_bars)", f"(SELECT * FROM all_bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= {BARS})")
