"""News of single stocks: provider payloads, stored news, selection; and the ledger of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import NINE, date_kst, zoned
from tidemark.functions.numbers import half_up
from tidemark.functions.text import plain, title_key
from tidemark.functions.urls import canonical_url
from tidemark.operators.news import analyzed, lookup_symbol, symbol_table


def normalize_provider_news(rows: DataFrame, provider: str, since: Column, until: Column) -> DataFrame:
    """News (id, provider, title, summary, url, observed_at) of a provider's rows (title, summary, link, date): tags and references out, dates by the provider's format, only http(s) URLs, only within the time asked for."""
    date = F.regexp_replace("date", r"^[A-Za-z]{3},\s*", "")
    when = F.try_to_timestamp(date, F.lit("dd MMM yyyy HH:mm:ss Z")) if provider == "Naver" else F.try_to_timestamp(F.regexp_replace("date", r"^(\d{8})T(\d{6})Z$", "$1$2"), F.lit("yyyyMMddHHmmss"))
    out = rows.select(F.lit(provider).alias("provider"), F.substring(plain(F.col("title")), 1, 300).alias("title"), F.substring(plain(F.coalesce("summary", F.lit(""))), 1, 800).alias("summary"), F.when(F.col("link").rlike("(?i)^https?://"), F.col("link")).otherwise(F.lit("")).alias("url"), when.alias("observed_at"))
    out = out.where((F.col("title") != "") & F.col("observed_at").between(since, until))
    return out.withColumn("id", F.sha2(F.concat_ws("\n", "provider", "url", "title"), 256))


def vendor_news(rows: DataFrame, limit: int = 8, vendor: str = "Yahoo Finance") -> DataFrame:
    """News (symbol, id, title, source, observed_at, summary, url) of a quote vendor's payload, an item a row (symbol, pos, json): what stands in `content` counts, else the item itself.

    The first `limit` items of a symbol are looked at; those without a title go. A time is a date with zone or seconds since the epoch; null if it is neither. An item without an id is numbered
    among those that stay.
    """
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("pos"))
    near = rows.withColumn("_n", n).where(F.col("_n") <= limit)
    nested = F.coalesce(F.get_json_object("json", "$.content").startswith("{"), F.lit(False))
    inner = lambda path: F.when(nested, F.get_json_object("json", f"$.content.{path}")).otherwise(F.get_json_object("json", f"$.{path}"))
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    date = first(inner("pubDate"), inner("providerPublishTime"))
    named = F.when(inner("provider").startswith("{"), F.coalesce(inner("provider.displayName"), F.lit("")))
    link = F.when(inner("canonicalUrl").startswith("{"), F.coalesce(inner("canonicalUrl.url"), F.lit(""))).otherwise(first(inner("link")))
    out = near.select(
        "symbol", "_n", first(inner("id"), F.get_json_object("json", "$.id")).alias("_id"), F.trim(first(inner("title"))).alias("title"), F.substring(F.coalesce(F.nullif(named, F.lit("")), F.lit(vendor)), 1, 100).alias("source"),
        date.alias("_date"), F.substring(first(inner("summary"), inner("description")), 1, 800).alias("summary"), F.substring(link, 1, 1000).alias("url"),
    )
    out = out.withColumn("observed_at", F.coalesce(F.timestamp_seconds(F.col("_date").try_cast("double")), zoned(F.col("_date"))))
    out = out.where("title <> ''").withColumn("_nth", F.row_number().over(Window.partitionBy("symbol").orderBy("_n")))
    return out.select("symbol", F.concat(F.lit("external-news:"), F.coalesce(F.nullif("_id", F.lit("")), F.col("_nth").cast("string"))).alias("id"), F.substring("title", 1, 300).alias("title"), "source", "observed_at", "summary", "url")


def stored_news(articles: DataFrame, bridge: DataFrame, insights: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """Stored news of queries (symbol, since, until), the newest first: a query's symbol counts without its exchange's suffix."""
    q = queries.withColumn("base", F.regexp_replace("symbol", r"\.(KS|KQ)$", ""))
    b = bridge.select(F.regexp_replace("symbol", r"\.(KS|KQ)$", "").alias("base"), "article_id").distinct()
    rows = q.join(b, "base").join(articles, "article_id").where(F.col("published_at").between(F.col("since"), F.col("until"))).join(insights.select("article_id", F.col("sentiment_score").alias("score")), "article_id", "left")
    n = F.row_number().over(Window.partitionBy(q["symbol"]).orderBy(F.desc("published_at"), F.desc("article_id")))
    return rows.select(q["symbol"].alias("symbol"), "article_id", "published_at", "score", n.alias("n")).where(F.col("n") <= limit)


#: Marks after a character that is no Latin letter or digit, and before one; both stand where a text begins and ends.
AFTER, BEFORE = "\u0001", "\u0002"


def marked(text: Column) -> Column:
    """A lower-cased text with marks at the edges of Latin words: a term stands in it as a whole word where its own marked form does."""
    return F.concat(F.lit(AFTER), F.regexp_replace(F.lower(text), "([^a-z0-9])", f"{BEFORE}$1{AFTER}"), F.lit(BEFORE))


def is_latin(term: Column) -> Column:
    """Whether a term is of printable ASCII."""
    return term.rlike(r"^[\x20-\x7E]+$")


def stock_queries(requests: DataFrame, companies: DataFrame | None = None, dictionary: DataFrame | None = None, days: int = 30) -> DataFrame:
    """Queries (symbol, terms, since, until, entry_symbol, entry_aliases) of requests (symbol, company, now): what a stock's news may call it.

    Terms are the request's company, names and aliases of the company that the symbol's base resolves to (companies: base, name, name_en, aliases), the aliases of the dictionary's
    entry for the symbol, and the symbol, each once and in this order. A symbol counts without its exchange's suffix.
    """
    spark = requests.sparkSession
    q = requests.withColumn("symbol", F.upper(F.regexp_replace(F.trim("symbol"), r"(?i)\.(KS|KQ)$", "")))
    none = F.array().cast("array<string>")
    if companies is None:
        q = q.withColumn("_names", none)
    else:
        names = companies.select(F.upper("base").alias("symbol"), F.concat(F.array("name", "name_en"), F.coalesce("aliases", none)).alias("_names"))
        q = q.join(names.dropDuplicates(["symbol"]), "symbol", "left")
    entries = (symbol_table(spark) if dictionary is None else dictionary).withColumnsRenamed({"symbol": "entry_symbol", "aliases": "entry_aliases"})
    found = lookup_symbol(q.select(F.col("symbol").alias("query")).distinct(), entries.withColumnsRenamed({"entry_symbol": "symbol", "entry_aliases": "aliases"}))
    found = found.where("symbol is not null").select(F.col("query").alias("symbol"), F.col("symbol").alias("entry_symbol"))
    per = entries.groupBy("entry_symbol").agg(F.min_by("entry_aliases", "pos").alias("entry_aliases"))
    q = q.join(found.join(per, "entry_symbol"), "symbol", "left")
    terms = F.concat(F.array("company"), F.coalesce("_names", none), F.coalesce("entry_aliases", none), F.array("symbol"))
    terms = F.array_distinct(F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "")))
    return q.select("symbol", terms.alias("terms"), (F.col("now") - F.make_interval(days=F.lit(days))).alias("since"), F.col("now").alias("until"), "entry_symbol", "entry_aliases")


def news_relevance(items: DataFrame, queries: DataFrame) -> DataFrame:
    """items (symbol, title, summary) with relevance to their query (symbol, terms): 2 in the title, 1 in the summary, 0 not at all.

    Latin terms count as whole words without case, others by letter; a ticker of up to three letters only where $, NASDAQ: or NYSE: stands before it. Each text is read once, by fixed patterns:
    it is marked at the edges of words, and a term stands in it where its marked form does. Items are neither multiplied by terms nor grouped.

    If the queries say which entry of the dictionary they stand for (entry_symbol, entry_aliases) and the items which symbols they mention (matches), an item that holds an alias, but only as part of
    another company's name, has relevance 0.
    """
    brief = lambda t: (F.upper(t) == F.col("symbol")) & t.rlike("^[A-Za-z]{1,3}$")
    form = lambda t: F.struct(t.alias("term"), is_latin(t).alias("latin"), marked(t).alias("mark"), F.when(brief(t), F.upper(t)).alias("ticker"))
    named = [c for c in ("entry_symbol", "entry_aliases") if c in queries.columns]
    q = queries.select("symbol", F.transform("terms", form).alias("_terms"), *[F.col(c).alias(f"_{c}") for c in named])
    if named:
        q = q.withColumn("_entry", F.transform("_entry_aliases", form))
    title, whole = F.coalesce("title", F.lit("")), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))
    rows = items.join(q, "symbol").withColumns({"_title": marked(title), "_whole": marked(whole)})
    tickers = F.transform(F.regexp_extract_all(whole, F.lit(r"(?i)(?:\$|NASDAQ[:\s]+|NYSE[:\s]+)([A-Z]{1,3})(?![\p{L}\p{N}_])"), F.lit(1)), F.upper)
    rows = rows.withColumn("_tickers", tickers)
    holds = lambda x, plain, c: F.when(x["latin"], F.contains(F.col(c), x["mark"])).otherwise(F.contains(plain, x["term"]))
    kept = F.filter("_terms", lambda x: holds(x, whole, "_whole") & (x["ticker"].isNull() | F.array_contains("_tickers", x["ticker"])))
    hit = F.when(F.exists(kept, lambda x: holds(x, title, "_title")), 2).when(F.size(kept) > 0, 1).otherwise(0)
    if named and "matches" in items.columns:
        other = F.col("_entry_symbol").isNotNull() & ~F.exists("matches", lambda m: m["symbol"] == F.col("_entry_symbol")) & F.exists("_entry", lambda x: holds(x, whole, "_whole"))
        hit = F.when(F.coalesce(other, F.lit(False)), 0).otherwise(hit)
    return rows.select(*[F.col(f"`{c}`") for c in items.columns], hit.alias("relevance"))


def select_stock_news(items: DataFrame, queries: DataFrame, limit: int = 12) -> tuple[DataFrame, DataFrame]:
    """(news chosen for each query, counts by provider) from items (symbol, provider, seq, title, summary, url, observed_at, score).

    Items outside a query's time or without relevance go. An item that is chosen without a score gets that of the rule-based reading. One item is kept for each URL (or title, where there is none): the first, unless it isn't from the
    store and the store has a scored one. The rest is ranked by relevance, time and id.
    """
    rows = items.join(queries.select("symbol", "since", "until"), "symbol").where(F.col("observed_at").between(F.col("since"), F.col("until")))
    rows = news_relevance(rows, queries).where("relevance > 0")
    url = F.when(F.col("url").rlike("(?i)^https?://"), canonical_url(F.col("url"))).otherwise(F.lit(""))
    rows = rows.withColumn("key", F.coalesce(F.nullif(url, F.lit("")), title_key(F.col("title")))).where("key <> ''")
    scored = (F.col("provider") == "DB") & F.col("score").isNotNull()
    w = Window.partitionBy("symbol", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"first": F.first("provider").over(w), "any": F.max(scored).over(w)})
    better = F.when((F.col("first") != "DB") & F.col("any"), F.when(scored, 0).otherwise(1)).otherwise(0)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("symbol", "key").orderBy(better, "seq"))).where("n = 1")
    rows = rows.withColumn("id", F.concat(F.lit("stock-news:"), F.substring(F.sha2("key", 256), 1, 32)))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("relevance"), F.desc("observed_at"), "id"))
    chosen = rows.withColumn("rank", rank).where(F.col("rank") <= limit)
    read = analyzed(chosen.select("symbol", "id", "title", "summary"), F.concat("title", F.lit(". "), F.coalesce("summary", F.lit(""))))
    read = read.select("symbol", "id", half_up(F.col("sentiment_score")).cast("double").alias("_read"))
    chosen = chosen.join(read, ["symbol", "id"]).withColumn("score", F.coalesce(F.col("score").cast("double"), "_read"))
    chosen = chosen.select("symbol", "rank", "id", "provider", "title", "url", "observed_at", "relevance", "score")
    fetched = items.groupBy("symbol", "provider").agg(F.count("*").alias("fetched"))
    accepted = chosen.groupBy("symbol", "provider").agg(F.count("*").alias("accepted"))
    return chosen, fetched.join(accepted, ["symbol", "provider"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))


def classify_failure(status: Column, detail: Column) -> Column:
    """What kind of failure a call's status is: quota, auth, transient or request."""
    hint = F.coalesce(detail.rlike("(?i)quota|rate.?limit|exceed|insufficient|balance|billing"), F.lit(False))
    return F.when(status.isin(429, 402), "quota").when(status.isin(401, 403), "auth").when((status >= 500) | status.isin(408, 0), "transient").when((status == 400) & hint, "quota").otherwise("request")


def cooldown_until(kind: Column, detail: Column, ts: Column) -> Column:
    """When a provider may be asked again: a 429 says how long (15 to 300 seconds, 60 if it doesn't) or that the day is used up; other quotas rest for an hour but not past midnight in Korea."""
    midnight = F.date_trunc("DAY", ts + F.expr(NINE)) + F.expr("INTERVAL 15 HOURS")
    delay = F.regexp_extract(detail, r"retryDelay\"?\s*:\s*\"?(\d+(?:\.\d+)?)s", 1).try_cast("double")
    wait = F.make_dt_interval(secs=F.greatest(F.lit(15.0), F.least(F.lit(300.0), F.coalesce(delay, F.lit(60.0)))).cast("decimal(18,6)"))
    told = detail.startswith("429")
    quota = F.when(told & detail.rlike("(?i)per.?day|daily"), midnight).when(told, ts + wait).otherwise(F.least(midnight, ts + F.expr("INTERVAL 1 HOUR")))
    return F.when(kind == "quota", quota).when(kind == "auth", ts + F.expr("INTERVAL 6 HOURS")).when(kind == "request", ts + F.expr("INTERVAL 30 MINUTES")).when(kind == "transient", ts + F.expr("INTERVAL 5 MINUTES"))


def provider_ledger(calls: DataFrame) -> DataFrame:
    """Per provider from its calls (provider, ts, status, detail; 200 is success): uses on its last day in Korea, successes, failures, last state and the end of its rest."""
    ok = F.col("status") == 200
    c = calls.withColumns({"day": date_kst(F.col("ts")), "kind": F.when(~ok, classify_failure(F.col("status"), F.col("detail")))})
    c = c.withColumn("until", cooldown_until(F.col("kind"), F.coalesce("detail", F.lit("")), F.col("ts")))
    per = c.groupBy("provider", "day").agg(F.count("*").alias("used"), F.count_if(ok).alias("good"), F.max(F.struct("ts", F.coalesce("kind", F.lit("정상")).alias("state"), "until")).alias("last"))
    return per.groupBy("provider").agg(F.max("day").alias("usage_date_kst"), F.max_by("used", "day").alias("used_today"), F.sum("good").alias("success_count"), F.sum(F.col("used") - F.col("good")).alias("failure_count"), F.max("last").alias("last")).select("provider", "usage_date_kst", "used_today", "success_count", "failure_count", F.col("last.state").alias("last_status"), F.col("last.until").alias("cooldown_until"))
