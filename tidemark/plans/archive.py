"""Archive queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import archive as ops
from tidemark.operators import search
from tidemark.plans.registry import query
from tidemark.sources import bindings as b
from tidemark.sources import tables
from tidemark.sources.bindings import ARTICLES, BRIDGE, INSIGHTS, MENTIONS, PUBLISHERS, RUNS, SOURCES

NOW = datetime(2024, 1, 15, 12)


def millis(c: str) -> F.Column:
    """A timestamp as milliseconds."""
    return F.unix_millis(c).alias(c)


@query(f"""WITH {ARTICLES} SELECT article_id, epoch_ms(published_at) AS published_at FROM articles
WHERE published_at BETWEEN TIMESTAMP '2024-01-01 12:00:00' - INTERVAL 36 HOUR AND TIMESTAMP '2024-01-01 12:00:00' + INTERVAL 2 HOUR""")
def f1_select_recent(spark, d):
    """articles of the last 36 hours."""
    return ops.select_recent(b.articles(spark, d), datetime(2024, 1, 1, 12)).select("article_id", millis("published_at"))


@query("""SELECT event_id, CASE WHEN value IS NULL OR value <= 0 THEN 36 WHEN value > 168 THEN 168 ELSE greatest(6, floor(value))::INT END AS hours FROM events""")
def f2_clamp_window(spark, d):
    """windows clamped to whole hours from 6 to 168."""
    return b.table(spark, d, "events").select("event_id", ops.clamp_window_hours(F.col("value")).alias("hours"))


@query(f"""WITH {ARTICLES}, {INSIGHTS}, {BRIDGE} SELECT a.article_id, title FROM articles a LEFT JOIN insights i USING (article_id)
WHERE cast(coalesce(published_at, collected_at) + INTERVAL 9 HOUR AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-25' AND sentiment = '긍정'
  AND (contains(lower(title), 'the') OR contains(lower(body), 'the') OR contains(lower(coalesce(summary, '')), 'the'))
  AND article_id IN (SELECT article_id FROM bridge WHERE symbol = 'S62')""")
def f3_archive_filter(spark, d):
    """All predicates of the archive at once."""
    found = ops.archive_filter(b.articles(spark, d).withColumn("excerpt", F.col("body")), b.insights(spark, d), b.bridge(spark, d), "2024-01-01", "2024-01-25", None, "긍정", "S62", "The")
    return found.select("article_id", "title")


@query(f"WITH {ARTICLES}, {INSIGHTS} SELECT article_id, engine FROM insights WHERE list_contains(words, 'the')")
def f4_has_keyword_any(spark, d):
    """insights whose title holds a word, by exact membership."""
    a = b.articles(spark, d).select("article_id", F.split(F.lower("title"), " ").alias("words"))
    return ops.has_keyword(b.insights(spark, d).join(a, "article_id"), "the", "words").select("article_id", "engine")


@query(f"WITH {ARTICLES}, {PUBLISHERS} SELECT source_id, name, epoch_ms(next_crawl_at) AS next_crawl_at FROM publishers WHERE is_active AND next_crawl_at <= TIMESTAMP '2024-01-15 12:00:00' ORDER BY next_crawl_at, source_id LIMIT 20")
def f5_due_sources(spark, d):
    """Sources that are due."""
    return ops.due_sources(b.publishers(spark, d), NOW).select("source_id", "name", millis("next_crawl_at"))


@query(f"WITH {ARTICLES} SELECT article_id FROM articles WHERE insight_status = '대기' ORDER BY published_at DESC NULLS FIRST, collected_at DESC, article_id DESC LIMIT 50")
def f6_pending_queue(spark, d):
    """the queue of waiting articles."""
    return ops.pending_queue(b.articles(spark, d), 200).select("article_id")


@query(f"WITH {ARTICLES} SELECT article_id, title FROM articles WHERE published_at >= TIMESTAMP '2024-01-01 00:00:00' ORDER BY published_at DESC, article_id DESC LIMIT 40")
def f7_recent_articles(spark, d):
    """the newest articles."""
    return ops.recent_articles(b.articles(spark, d), datetime(2024, 1, 1)).select("article_id", "title")


@query(f"""WITH {ARTICLES}, {BRIDGE} SELECT a.article_id, coalesce(n, 0) > 0 OR materiality <> '낮음' OR length(body) >= 1200 AS worth FROM articles a
LEFT JOIN (SELECT article_id, count(*) AS n FROM bridge WHERE mentions > 2 GROUP BY 1) s USING (article_id)""")
def f8_deserves_llm(spark, d):
    """F8: which articles are worth a model's reading."""
    n = b.bridge(spark, d).where("mentions > 2").groupBy("article_id").agg(F.count("*").alias("n"))
    return b.articles(spark, d).join(n, "article_id", "left").select("article_id", ops.deserves_llm(F.coalesce("n", F.lit(0)), F.col("materiality"), F.length("body")).alias("worth"))


@query(f"""WITH {RUNS}, {SOURCES}, c AS (SELECT c_custkey % 25 AS source_id, c_custkey FROM customer)
SELECT s.source_id, name, (SELECT count(DISTINCT c_custkey) FROM c WHERE c.source_id = s.source_id) AS articles, (SELECT count(DISTINCT run_id) FROM runs r WHERE r.source_id = s.source_id) AS runs FROM sources s""")
def j6_source_stats(spark, d):
    """Articles and runs of every source, zeros kept."""
    a = b.table(spark, d, "customer").select((F.col("c_custkey") % 25).alias("source_id"), F.col("c_custkey").alias("article_id"))
    return ops.source_stats(b.sources(spark, d), a, b.runs(spark, d))


@query(f"""WITH {ARTICLES}, store AS (SELECT DISTINCT title FROM articles WHERE article_id % 3 = 0),
b AS (SELECT * FROM articles WHERE article_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY title ORDER BY article_id) = 1)
SELECT source_id, count(*) AS inserted FROM b WHERE title NOT IN (SELECT title FROM store) GROUP BY 1""")
def io14_insert_new(spark, d):
    """IO14, J5, W15: what a batch adds to the store, by source (titles stand for URLs)."""
    a = b.articles(spark, d).withColumn("canonical_url", F.col("title"))
    return ops.insert_new_articles(a.where("article_id % 3 <> 0"), a.where("article_id % 3 = 0"))[1]


@query(f"WITH {ARTICLES} SELECT count(*) AS total, count(*) FILTER (sentiment = '긍정') AS positive, count(*) FILTER (sentiment = '부정') AS negative, count(*) FILTER (insight_status = '대기') AS pending FROM articles")
def a1_archive_summary(spark, d):
    """A1: totals of the archive."""
    return ops.archive_summary(b.articles(spark, d))


@query(f"WITH {ARTICLES}, {INSIGHTS} SELECT 'status' AS kind, insight_status AS value, count(*) AS n FROM articles GROUP BY 2 UNION ALL SELECT 'engine', engine, count(*) FROM insights GROUP BY 2")
def a2_queue_stats(spark, d):
    """A2: articles by state, insights by engine."""
    return ops.queue_stats(b.articles(spark, d), b.insights(spark, d))


@query(f"WITH {MENTIONS} SELECT symbol, 'C' || symbol AS company, count(*) AS n FROM mentions WHERE published_at >= TIMESTAMP '2024-01-28 00:00:00' GROUP BY 1 ORDER BY n DESC, symbol LIMIT 10")
def a3_top_symbols_48h(spark, d):
    """The symbols most mentioned in the last 48 hours."""
    m = b.mentions(spark, d)
    return ops.top_symbols(m.select("article_id", "published_at"), m.select("article_id", "symbol", F.concat(F.lit("C"), "symbol").alias("company")), datetime(2024, 1, 28))


@query(f"WITH {ARTICLES}, {BRIDGE} SELECT symbol, company, count(*) AS n FROM bridge JOIN articles USING (article_id) GROUP BY 1, 2 ORDER BY n DESC, symbol LIMIT 30".replace("SELECT symbol, company", "SELECT bridge.symbol, company").replace("ORDER BY n DESC, symbol", "ORDER BY n DESC, bridge.symbol"))
def a3_top_symbols_all(spark, d):
    """The symbols most mentioned at all."""
    return ops.top_symbols(b.articles(spark, d), b.bridge(spark, d), limit=30)


@query(f"WITH {ARTICLES} SELECT count(*) FILTER (published_at >= TIMESTAMP '2024-01-01 12:00:00' - INTERVAL 48 HOUR) AS recent_count, count(*) AS total_count FROM articles")
def a5_dashboard(spark, d):
    """A5: counts of the dashboard."""
    return ops.dashboard_counts(b.articles(spark, d), datetime(2024, 1, 1, 12))


@query(f"WITH {RUNS} SELECT count(DISTINCT source_id) AS sources, sum(inserted_count)::BIGINT AS inserted, sum(fetched_count)::BIGINT AS fetched, count(*) FILTER (status = '오류') AS failures, round(avg(date_diff('second', started_at, completed_at)), 6) AS mean_seconds FROM runs")
def a6_crawl_summary(spark, d):
    """What the crawls brought."""
    return ops.crawl_summary(b.runs(spark, d)).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query(f"""WITH {ARTICLES}, o AS (SELECT insight_status AS state, CASE WHEN article_id % 3 = 0 THEN 'rule' ELSE 'llm' || (article_id % 2) END AS engine FROM articles)
SELECT count(*) AS picked, count(*) FILTER (state = '완료') AS done, count(*) FILTER (state = '완료' AND engine <> 'rule') AS llm, count(*) FILTER (state = '완료' AND engine = 'rule') AS rule, count(*) FILTER (state = '오류') AS failed,
(SELECT to_json(map_from_entries(list(struct_pack(k := engine, v := n) ORDER BY engine)))::VARCHAR FROM (SELECT engine, count(*) AS n FROM o WHERE state = '완료' GROUP BY 1)) AS by_engine FROM o""")
def a7_process_summary(spark, d):
    """What a round of analysis did."""
    k = F.col("article_id")
    o = b.articles(spark, d).select(F.col("insight_status").alias("state"), F.when(k % 3 == 0, "rule").otherwise(F.concat(F.lit("llm"), (k % 2).cast("string"))).alias("engine"))
    return ops.process_summary(o).withColumn("by_engine", F.to_json("by_engine"))


@query(f"WITH {ARTICLES} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM articles GROUP BY 2" for c in ("sentiment", "materiality", "insight_status", "source_id")))
def a18_facets(spark, d):
    """Counts for the lists' filters."""
    return ops.facets(b.articles(spark, d), ["sentiment", "materiality", "insight_status", "source_id"])


@query(f"WITH {ARTICLES} SELECT article_id, epoch_ms(published_at) AS published_at, sentiment FROM articles ORDER BY articles.published_at DESC NULLS FIRST, article_id DESC LIMIT 30 OFFSET 30")
def k1_archive_page(spark, d):
    """K1: the archive's second page."""
    return ops.archive_page(b.articles(spark, d), 2).select("article_id", millis("published_at"), "sentiment")


@query(f"WITH {RUNS} SELECT run_id, status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 8")
def k9_latest_runs(spark, d):
    """K9: the latest runs."""
    return ops.latest(b.runs(spark, d), [F.desc("started_at"), F.desc("run_id")], 8).select("run_id", "status")


@query(f"""WITH {ARTICLES}, {INSIGHTS} SELECT article_id, coalesce(n.engine, o.engine) AS engine, CASE WHEN n.article_id IS NULL THEN 2 WHEN o.article_id IS NULL THEN 1 ELSE 3 END AS attempts,
  n.article_id IS NULL AS failed FROM (SELECT * FROM insights WHERE article_id % 2 = 0) o FULL JOIN (SELECT * FROM insights WHERE article_id % 3 <> 1) n USING (article_id)""")
def io15_upsert_insights(spark, d):
    """IO15: insights of a second round laid over the first."""
    i = b.insights(spark, d).select("article_id", "engine", "summary")
    t = F.lit(NOW).cast("timestamp")
    old = i.where("article_id % 2 = 0").withColumns({"attempts": F.lit(2), "error": F.lit("x"), "created_at": t, "updated_at": t})
    out = ops.upsert_insights(old, i.where("article_id % 3 <> 1"), NOW)
    return out.select("article_id", "engine", "attempts", F.col("error").isNotNull().alias("failed"))


@query(f"""WITH {ARTICLES}, {BRIDGE}, n AS (SELECT article_id, 'N' || symbol AS symbol FROM bridge WHERE article_id % 3 = 0)
SELECT article_id, symbol FROM bridge WHERE article_id NOT IN (SELECT article_id FROM n) UNION ALL SELECT * FROM n""")
def io16_replace_symbols(spark, d):
    """IO16, U1: symbols of articles that were analysed again."""
    s = b.bridge(spark, d).select("article_id", "symbol")
    return ops.replace_symbols(s, s.where("article_id % 3 = 0").withColumn("symbol", F.concat(F.lit("N"), "symbol")))


@query(f"WITH {RUNS} SELECT run_id, CASE WHEN status = '실행 중' AND started_at < TIMESTAMP '1998-01-01' - INTERVAL 30 MINUTE THEN '오류' ELSE status END AS status FROM runs")
def st4_reap_stuck(spark, d):
    """ST4: runs that hang are failed."""
    return ops.reap_stuck_runs(b.runs(spark, d), datetime(1998, 1, 1)).select("run_id", "status")


@query(f"WITH {ARTICLES}, {PUBLISHERS} SELECT article_id, title, p.name AS source_name FROM articles JOIN publishers p USING (source_id)")
def j1_with_source(spark, d):
    """Articles with their sources' names."""
    return ops.with_source(b.articles(spark, d), b.publishers(spark, d)).select("article_id", "title", "source_name")


@query(f"""WITH {ARTICLES} SELECT article_id FROM articles WHERE published_at < TIMESTAMP '2024-01-10 03:00:00' OR published_at = TIMESTAMP '2024-01-10 03:00:00' AND article_id < 500
ORDER BY published_at DESC NULLS FIRST, article_id DESC LIMIT 30""")
def k1_archive_after(spark, d):
    """K1: the page that follows an article, by filter."""
    return ops.archive_after(b.articles(spark, d), datetime(2024, 1, 10, 3), 500).select("article_id")


@query(f"WITH {ARTICLES} SELECT article_id, epoch_ms(published_at) AS published_at FROM articles ORDER BY articles.published_at DESC NULLS FIRST, article_id DESC LIMIT 30 OFFSET 570")
def k1_indexed_page(spark, d):
    """K1: the archive's twentieth page by a boundary index."""
    a = b.articles(spark, d)
    return ops.indexed_page(a, ops.archive_index(a, 100), 20, 30, 100).select("article_id", millis("published_at"))


@query(f"""WITH {ARTICLES} SELECT article_id FROM articles WHERE published_at IS NULL AND article_id < 500 OR published_at IS NOT NULL ORDER BY published_at DESC NULLS FIRST, article_id DESC LIMIT 30""")
def k1_after_undated(spark, d):
    """K1: the page that follows an article without time."""
    return ops.archive_after(b.articles(spark, d), None, 500).select("article_id")


@query(f"WITH {ARTICLES}, {INSIGHTS} SELECT article_id, engine FROM insights WHERE list_contains(words, 'the')")
def f4_keyword_index(spark, d):
    """insights with a word, by an index of words whose folder for the word alone is read."""
    i = b.insights(spark, d)
    words = b.articles(spark, d).where("insight_status = '완료'").select("article_id", F.split(F.lower("title"), " ").alias("words"))
    path = tables.folder(spark)
    search.write_index(search.keyword_postings(words, "words"), path)
    return search.search_keyword(i, path, "the").select("article_id", "engine")


@query(f"WITH {ARTICLES} SELECT article_id FROM articles WHERE contains(lower(title), 'the and') OR contains(lower(body), 'the and')")
def f3_text_index(spark, d):
    """articles that hold a phrase, by an index of trigrams of whole texts."""
    a = b.articles(spark, d)
    path = tables.folder(spark)
    search.write_index(search.text_postings(a, ["title", "body"]), path)
    return search.search_text(a, ["title", "body"], path, "The and").select("article_id")
