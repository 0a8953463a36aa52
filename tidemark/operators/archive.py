"""Archive search, queues and roll-ups over articles, sources and crawl runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import kept

#: Recency window in hours (default, least, most), hours a time may lie ahead.
WINDOW_HOURS, LEAST_HOURS, MOST_HOURS, AHEAD_HOURS = 36, 6, 168, 2


def clamp_window_hours(c: Column) -> Column:
    """Whole hours between the least and the most; missing, infinite or not above zero gives the default."""
    d = c.cast("double")
    fine = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")) & (d > 0)
    whole = F.when(d > MOST_HOURS, F.lit(float(MOST_HOURS))).otherwise(F.floor(d))
    return F.when(fine, F.greatest(F.lit(LEAST_HOURS), F.least(F.lit(MOST_HOURS), whole.cast("int")))).otherwise(F.lit(WINDOW_HOURS))


def select_recent(items: DataFrame, now: datetime, window_hours: Column | int = WINDOW_HOURS) -> DataFrame:
    """Items published within the window before now, or up to two hours after; both ends count, a missing time doesn't."""
    hours = clamp_window_hours(F.lit(window_hours) if isinstance(window_hours, int) else window_hours)
    t = F.lit(now).cast("timestamp")
    return items.where(F.col("published_at").between(t - F.make_dt_interval(hours=hours), t + F.make_dt_interval(hours=F.lit(AHEAD_HOURS))))


def date_kst(ts: Column) -> Column:
    """The calendar day in Korea, nine hours ahead of UTC."""
    return F.to_date(ts + F.expr("INTERVAL 9 HOURS"))


def archive_filter(articles: DataFrame, insights: DataFrame, bridge: DataFrame, date_from: str | None = None, date_to: str | None = None, source: object = None, sentiment: str | None = None, symbol: str | None = None, q: str | None = None) -> DataFrame:
    """Articles that meet all given predicates: days in Korea (inclusive), source, sentiment, a mentioned symbol, a substring of title, excerpt or summary."""
    out = articles.join(insights.select("article_id", F.col("summary").alias("_summary")), "article_id", "left") if q else articles
    day = date_kst(F.coalesce("published_at", "collected_at"))
    if date_from:
        out = out.where(day >= F.lit(date_from).cast("date"))
    if date_to:
        out = out.where(day <= F.lit(date_to).cast("date"))
    if source is not None:
        out = out.where(F.col("source_id") == source)
    if sentiment:
        out = out.where(F.col("sentiment") == sentiment)
    if q:
        held = F.lit(False)
        for c in ("title", "excerpt", "_summary"):
            held = held | F.coalesce(F.lower(c).contains(q.lower()), F.lit(False))
        out = out.where(held).drop("_summary")
    if symbol:
        out = out.join(bridge.where(F.col("symbol") == symbol).select("article_id"), "article_id", "left_semi")
    return out


def has_keyword(insights: DataFrame, keyword: str, column: str = "keywords") -> DataFrame:
    """Insights whose array holds the word exactly."""
    return insights.where(F.array_contains(column, keyword))


def due_sources(sources: DataFrame, now: datetime, limit: int = 20) -> DataFrame:
    """Active sources whose next crawl is due, the earliest first."""
    return sources.where("is_active").where(F.col("next_crawl_at") <= F.lit(now).cast("timestamp")).orderBy("next_crawl_at", "source_id").limit(limit)


def pending_queue(articles: DataFrame, limit: int = 12) -> DataFrame:
    """Waiting articles, the newest first, those without time before all; from 1 to 50 of them."""
    order = [F.desc_nulls_first("published_at"), F.desc_nulls_first("collected_at"), F.desc("article_id")]
    return articles.where("insight_status = '대기'").orderBy(*order).limit(max(1, min(50, limit)))


def archive_summary(articles: DataFrame) -> DataFrame:
    """One row: articles in all, positive, negative, waiting."""
    return articles.agg(F.count("*").alias("total"), F.count_if(F.col("sentiment") == "긍정").alias("positive"), F.count_if(F.col("sentiment") == "부정").alias("negative"), F.count_if(F.col("insight_status") == "대기").alias("pending"))


def newest() -> list[Column]:
    """The archive's order."""
    return [F.desc_nulls_first("published_at"), F.desc("article_id")]


def archive_page(articles: DataFrame, page: int = 1, size: int = 30) -> DataFrame:
    """A page of articles by time, newest first, those without time before all. Pages far back go by archive_index and indexed_page."""
    return articles.orderBy(*newest()).offset((max(1, page) - 1) * size).limit(size)


def not_before(published_at: datetime | None, article_id: int, itself: bool) -> Column:
    """Whether an article stands after a given one in the archive's order (or is it); one without time stands among those without time."""
    ids = F.col("article_id") <= article_id if itself else F.col("article_id") < article_id
    undated = F.col("published_at").isNull()
    if published_at is None:
        return (undated & ids) | ~undated
    t = F.lit(published_at).cast("timestamp")
    return ~undated & ((F.col("published_at") < t) | ((F.col("published_at") == t) & ids))


def archive_after(articles: DataFrame, published_at: datetime | None, article_id: int, size: int = 30) -> DataFrame:
    """The page that follows a given article, by filter instead of offset; published_at is null for an article without time."""
    return articles.where(not_before(published_at, article_id, False)).orderBy(*newest()).limit(size)


def archive_index(articles: DataFrame, every: int = 3000) -> DataFrame:
    """(nth, published_at, article_id): the article at every so many places of the archive's order, the first being nth 0; to be stored beside the archive.

    Articles' keys are ranged over tasks and counted by range, so a place follows from the ranges before its own and its row within: no task sorts them all.
    """
    keys = articles.select("published_at", "article_id").repartitionByRange(*newest()).sortWithinPartitions(*newest())
    keys = keys.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id() % (1 << 33)})
    keys = kept(keys)
    sizes = keys.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = sizes.select("part", before.alias("before"))
    nth = F.col("before") + F.col("row")
    return keys.join(starts, "part").where(nth % every == 0).select(F.floor(nth / every).alias("nth"), "published_at", "article_id")


def indexed_page(articles: DataFrame, index: DataFrame, page: int, size: int = 30, every: int = 3000) -> DataFrame:
    """The page of the same number by an index over the same articles: a filter on the key, so the scan reads the range that holds the page.

    The driver reads up to three rows of the index: those that bound the page.
    """
    start = (max(1, page) - 1) * size
    first, last = start // every, (start + size - 1) // every + 1
    keys = {r.nth: r for r in index.where(F.col("nth").isin(first, last)).collect()}
    if first not in keys:
        return articles.limit(0)
    rows = articles.where(not_before(keys[first].published_at, keys[first].article_id, True))
    if last in keys:
        rows = rows.where(~not_before(keys[last].published_at, keys[last].article_id, True))
    return rows.orderBy(*newest()).offset(start - first * every).limit(size)


def latest(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows by an order."""
    return df.orderBy(*order).limit(limit)


def queue_stats(articles: DataFrame, insights: DataFrame) -> DataFrame:
    """(kind, value, n): articles by state, with zeros for waiting, done and failed, and insights by engine."""
    spark = articles.sparkSession
    states = spark.createDataFrame([("대기",), ("완료",), ("오류",)], "value string")
    by_state = articles.groupBy(F.col("insight_status").alias("value")).agg(F.count("*").alias("n"))
    by_state = states.join(by_state, "value", "full").select(F.lit("status").alias("kind"), "value", F.coalesce("n", F.lit(0)).alias("n"))
    by_engine = insights.groupBy(F.col("engine").alias("value")).agg(F.count("*").alias("n")).select(F.lit("engine").alias("kind"), "value", "n")
    return by_state.unionByName(by_engine)


def top_symbols(articles: DataFrame, bridge: DataFrame, since: datetime | None = None, limit: int = 10) -> DataFrame:
    """(symbol, company, n): the symbols that most articles mention, since a time if one is given; ties by symbol."""
    if since is not None:
        articles = articles.where(F.col("published_at") >= F.lit(since).cast("timestamp"))
    hits = bridge.where("symbol is not null").join(articles.select("article_id"), "article_id")
    return hits.groupBy("symbol", "company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol", "company").limit(limit)


def source_stats(sources: DataFrame, articles: DataFrame, runs: DataFrame) -> DataFrame:
    """(source_id, name, articles, runs) for every source; each side is counted by itself, so neither multiplies the other."""
    a = articles.groupBy("source_id").agg(F.count_distinct("article_id").alias("articles"))
    r = runs.groupBy("source_id").agg(F.count_distinct("run_id").alias("runs"))
    out = sources.join(a, "source_id", "left").join(r, "source_id", "left")
    return out.select("source_id", "name", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("runs", F.lit(0)).alias("runs"))


def with_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with source_name, the name of their source; sources are few beside articles, and Spark's size estimate decides whether they are broadcast."""
    return articles.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")


def recent_articles(articles: DataFrame, since: datetime, limit: int = 40) -> DataFrame:
    """The newest articles since a time."""
    return articles.where(F.col("published_at") >= F.lit(since).cast("timestamp")).orderBy(F.desc("published_at"), F.desc("article_id")).limit(limit)


def dashboard_counts(articles: DataFrame, now: datetime, hours: int = 48) -> DataFrame:
    """One row: articles of the last hours, and all."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    return articles.agg(F.count_if(F.col("published_at") >= since).alias("recent_count"), F.count("*").alias("total_count"))


def crawl_summary(runs: DataFrame) -> DataFrame:
    """One row: sources that ran, rows inserted, failures, mean seconds of finished runs."""
    seconds = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    return runs.agg(F.count_distinct("source_id").alias("sources"), F.sum("inserted_count").alias("inserted"), F.sum("fetched_count").alias("fetched"), F.count_if(F.col("status") == "오류").alias("failures"), F.avg(seconds).alias("mean_seconds"))


def process_summary(outcomes: DataFrame) -> DataFrame:
    """One row of outcomes (state, engine): picked, done, llm, rule, failed, and done by engine as a map."""
    per = outcomes.where("state = '완료'").groupBy("engine").agg(F.count("*").alias("n"))
    by = per.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("engine", "n")))).alias("by_engine"))
    one = outcomes.agg(F.count("*").alias("picked"), F.count_if(F.col("state") == "완료").alias("done"), F.count_if((F.col("state") == "완료") & (F.col("engine") != "rule")).alias("llm"), F.count_if((F.col("state") == "완료") & (F.col("engine") == "rule")).alias("rule"), F.count_if(F.col("state") == "오류").alias("failed"))
    return one.crossJoin(F.broadcast(by))  # one row by one row


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): counts of each value of each column, in one pass."""
    sets = df.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    n = len(columns)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        mask = ((1 << n) - 1) ^ (1 << (n - 1 - i))
        name = F.when(F.col("g") == mask, F.lit(c)).otherwise(name)
        value = F.when(F.col("g") == mask, F.col(c).cast("string")).otherwise(value)
    return sets.select(name.alias("column"), value.alias("value"), "n")


def deserves_llm(n_symbols: Column, materiality: Column, body_chars: Column, least_chars: int = 1200) -> Column:
    """Whether an article is worth a model's reading: it names symbols, matters, or is long."""
    return F.coalesce((n_symbols > 0) | (materiality != "낮음") | (body_chars >= least_chars), F.lit(False))


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def insert_new_articles(batch: DataFrame, store: DataFrame, order: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the batch whose canonical_url the store lacks, the first of each; how many by source_id)."""
    new = first_wins(batch, ["canonical_url"], order or ["article_id"]).join(store.select("canonical_url"), "canonical_url", "left_anti")
    return new, new.groupBy("source_id").agg(F.count("*").alias("inserted"))


def upsert_insights(old: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """old with new's values by article_id: attempts go up by one, error is cleared, created_at is kept; rows only in one side are kept as they are (new ones begin)."""
    t = F.lit(now).cast("timestamp")
    kept = ("article_id", "attempts", "error", "created_at", "updated_at")
    values = [c for c in new.columns if c not in kept]
    o = old.select("article_id", F.struct(*[c for c in old.columns if c != "article_id"]).alias("o"), F.lit(True).alias("had"))
    n = new.select("article_id", F.struct(*values).alias("v"), F.lit(True).alias("has"))
    both = o.join(n, "article_id", "full")
    has, had = F.col("has").isNotNull(), F.col("had").isNotNull()
    return both.select(
        "article_id",
        *[F.when(has, F.col("v").getField(c)).otherwise(F.col("o").getField(c)).alias(c) for c in values],
        F.when(has & had, F.col("o.attempts") + 1).when(has, F.lit(1)).otherwise(F.col("o.attempts")).alias("attempts"),
        F.when(~has, F.col("o.error")).alias("error"),
        F.when(had, F.col("o.created_at")).otherwise(t).alias("created_at"),
        F.when(has, t).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def replace_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols of articles: those that new names are replaced as a whole."""
    return old.join(new.select("article_id").distinct(), "article_id", "left_anti").unionByName(new)


def reap_stuck_runs(runs: DataFrame, now: datetime, minutes: int = 30) -> DataFrame:
    """Runs that have been running for longer are failed."""
    stuck = (F.col("status") == "실행 중") & (F.col("started_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))
    return runs.withColumn("status", F.when(stuck, "오류").otherwise(F.col("status"))).withColumn("completed_at", F.when(stuck, F.lit(now).cast("timestamp")).otherwise(F.col("completed_at")))
