"""Text queries: lexicons, keywords, bodies, URLs and dates over documents and pages.

The invented text holds none of the default words, so lexicons are drawn from it.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from tidemark.functions import dates, text, urls
from tidemark.operators import news
from tidemark.plans.registry import query, rounded
from tidemark.sources import bindings as b
from tidemark.sources import feeds
from tidemark.sources.bindings import ARTICLES, RUNS

GOOD, BAD, WEIGHTY = ["tion", "ment", "ung", "ado"], ["the", "les", "sch", "que"], ["ing", "eau", "keit", "ción"]


def contains_sql(words: list[str]) -> str:
    """Distinct words held, in SQL."""
    return " + ".join(f"contains(lower(t), '{w}')::INT" for w in words)


COMPACT = r"trim(regexp_replace({}, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
ANALYSIS_SQL = f"""{ARTICLES}, c AS (SELECT article_id, {COMPACT.format("substr(title || '. ' || body, 1, 6500)")} AS t FROM articles),
n AS (SELECT *, {contains_sql(GOOD)} AS pos, {contains_sql(BAD)} AS neg, {contains_sql(WEIGHTY)} AS imp FROM c),
m AS (SELECT *, pos - neg AS raw, CASE WHEN imp >= 3 THEN '높음' WHEN imp >= 1 THEN '보통' ELSE '낮음' END AS materiality,
  CASE WHEN regexp_matches(lower(t), 'earnings|revenue|guidance|forecast') THEN '실적·가이던스' WHEN regexp_matches(lower(t), 'contract|order') THEN '수주·사업계약' WHEN regexp_matches(lower(t), 'regulation|lawsuit|probe') THEN '규제·법률' WHEN regexp_matches(lower(t), 'investment|partnership') THEN '투자·파트너십' ELSE '산업·시장동향' END AS event_type FROM n)"""


@query(f"""WITH {ANALYSIS_SQL} SELECT article_id, CASE WHEN raw > 0 THEN '긍정' WHEN raw < 0 THEN '부정' ELSE '중립' END AS sentiment, greatest(0, least(100, 50 + raw * 11))::INT AS sentiment_score,
  least(100, 48 + least(imp * 5, 19))::INT AS relevance, materiality, event_type,
  CASE WHEN event_type = '실적·가이던스' THEN '중기(1~2분기)' WHEN event_type = '수주·사업계약' THEN '장기(1년+)' WHEN materiality = '낮음' THEN '당일' ELSE '단기(1~4주)' END AS impact_horizon,
  round(least(100, 52 + least(length(t) / 45.0::DOUBLE, 18) + imp * 2), 6) AS confidence,
  floor(greatest(-8, least(8, raw * CASE materiality WHEN '높음' THEN 2.4::DOUBLE WHEN '보통' THEN 1.5 ELSE 0.7 END)) + 0.5)::INT AS score_adjustment,
  pos > 0 AS bull, neg > 0 AS bear, list_transform(coalesce(nullif(list_filter(regexp_split_to_array(regexp_replace(t, '([.!?。])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 18), []), [t])[1:3], lambda x: substr(x, 1, 150)) AS evidence, 3 AS watched FROM m""")
def t4_analyze_news(spark, d):
    """The rule-based reading of articles (of 6500 characters, as the rules have it)."""
    a = b.spread(b.articles(spark, d)).select("article_id", F.substring(F.concat("title", F.lit(". "), "body"), 1, 6500).alias("t"))
    out = news.analyzed(a, F.col("t"), positive=GOOD, negative=BAD, material=WEIGHTY)
    out = out.select("article_id", "sentiment", F.col("sentiment_score").cast("int").alias("sentiment_score"), F.col("relevance").cast("int").alias("relevance"), "materiality", "event_type", "impact_horizon", F.col("confidence").cast("double").alias("confidence"), "score_adjustment", (F.col("bull_case") == text.BULL[0]).alias("bull"), (F.col("bear_case") == text.BEAR[0]).alias("bear"), "evidence", F.size("watch_items").alias("watched"))
    return rounded(out, ["confidence"])


STOP_SQL = ", ".join(f"'{w}'" for w in text.STOPWORDS if w.isascii())


@query(f"""WITH {ARTICLES}, t AS (SELECT article_id, unnest(regexp_split_to_array(title, '[^0-9A-Za-z가-힣%]+')) AS token, 4 AS w FROM articles UNION ALL SELECT article_id, unnest(regexp_split_to_array(body, '[^0-9A-Za-z가-힣%]+')), 1 FROM articles),
k AS (SELECT article_id, token, sum(w) AS w FROM t WHERE length(token) BETWEEN 2 AND 20 AND lower(token) NOT IN ({STOP_SQL}) AND NOT regexp_matches(token, '^[0-9]+$') AND NOT regexp_matches(token, '^[A-Za-z]{{1,3}}$') GROUP BY 1, 2 HAVING sum(w) > 1),
n AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY w DESC, token) AS n FROM k)
SELECT article_id, coalesce(string_agg(token, ',' ORDER BY n) FILTER (n <= 8), '') AS keywords FROM articles LEFT JOIN n USING (article_id) GROUP BY 1""")
def t8_keywords(spark, d):
    """Keywords of articles."""
    return news.keywords(b.spread(b.articles(spark, d))).withColumn("keywords", F.array_join("keywords", ","))


@query(f"""WITH {ARTICLES} SELECT article_id, sha256(title || chr(10) || body) AS content_hash, regexp_replace(lower(body), '[^\\p{{{{L}}}}\\p{{{{N}}}}]', '', 'g') AS title_key, sha256(CASE WHEN article_id % 2 = 0 AND length(body) > 300 THEN body ELSE substr(body, 1, 300) END) AS chosen FROM articles""".replace("{{", "{").replace("}}", "}"))
def t10_hashes(spark, d):
    """Content hash and key of whole texts; the choice between what was fetched, every other time too short, and a stored excerpt."""
    a = b.articles(spark, d)
    fetched = F.when(F.col("article_id") % 2 == 0, F.col("body")).otherwise(F.substring("body", 1, 10))
    chosen = news.choose_body(fetched, F.substring("body", 1, 300))
    return a.select("article_id", text.content_hash(F.col("title"), F.col("body")).alias("content_hash"), text.title_key(F.col("body")).alias("title_key"), F.sha2(chosen, 256).alias("chosen"))


@query(f"""WITH {ARTICLES} SELECT article_id, len(regexp_extract_all(lower(' ' || regexp_replace(body, '([^A-Za-z0-9])', '\\1\\1', 'g') || ' '), '[^a-z0-9]the[^a-z0-9]')) AS n FROM articles""")
def t6_occurrences(spark, d):
    """Whole-word occurrences of a Latin alias."""
    return b.articles(spark, d).select("article_id", text.occurrences(F.col("body"), "the").cast("long").alias("n"))


@query(r"""WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script)\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g') AS h FROM pages)
SELECT page_id, substr(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '&copy;', chr(1) || 'copy;'), '&middot;', chr(1) || 'middot;'), '&lt;', '<'), '&quot;', '"'), '&amp;', '&'), '[\s\x{a0}]+', ' ', 'g')), 1, 6000) AS t FROM c""".replace("AS t FROM c", "AS t0 FROM c").replace("SELECT page_id, substr", "SELECT page_id, replace(substr").replace("6000) AS t0", "6000), chr(1), '&') AS text"))
def t1_clean_text(spark, d):
    """Pages as clean text."""
    return b.table(spark, d, "pages").select("page_id", text.clean_text(F.col("html")).alias("text"))


GONE = "script style noscript iframe svg form nav header footer aside".split()


def dropped_sql(c: str, tags: list[str]) -> str:
    """Elements of some kinds taken out, the first that begins first; the test's pages don't have one in another."""
    return f"regexp_replace({c}, '(?is)" + "|".join(f"<{t}\\b[^>]*>.*?</{t}>" for t in tags) + "', ' ', 'g')"


def plain_sql(c: str) -> str:
    """A fragment as text."""
    out = f"replace(replace(replace(replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&quot;', '\"'), '&#x27;', ''''), '&nbsp;', ' ')"
    out = f"regexp_replace({out}, '&(copy|middot);', ' ', 'g')"
    return COMPACT.format(f"replace({out}, '&amp;', '&')")


@query(f"""WITH c AS (SELECT page_id, {dropped_sql("regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')", GONE)} AS h FROM pages),
p AS (SELECT page_id, h, list_filter(list_transform(regexp_extract_all(h, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: {plain_sql("x")}), lambda x: length(x) >= 20 AND NOT regexp_matches(x, '{text.BOILERPLATE}')) AS p FROM c),
q AS (SELECT *, list_transform(regexp_extract_all(h, '(?is){"|".join(f"<{t}\\b[^>]*>.*?</{t}>" for t in ("article", "section", "div"))}'), lambda x: {plain_sql("x")}) AS b FROM p)
SELECT page_id, substr(CASE WHEN len(p) >= 2 THEN array_to_string(p, chr(10)) WHEN len(b) > 0 THEN list_reduce(list_prepend('', b), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END) ELSE {plain_sql("h")} END, 1, 9000) AS body FROM q""")
def io6_extract_body(spark, d):
    """IO6: article bodies of pages."""
    body = text.extract_body(F.col("html"))
    return b.table(spark, d, "pages").select("page_id", body.alias("body"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
s AS (SELECT page_id, regexp_extract(u, '^(https?://[^/?]+)', 1) AS o, regexp_extract(u, '^https?://[^/?]+([^?]*)', 1) AS p, regexp_extract(u, '\?(.*)$', 1) AS q FROM p),
k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: NOT starts_with(x, 'utm_') AND split_part(x, '=', 1) NOT IN ('ref', 'section', 'from', 'cp', 'sid')), '&') AS r FROM s)
SELECT page_id, o || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN r <> '' THEN '?' || r ELSE '' END AS url, CASE WHEN regexp_matches(q, '(^|&)page=\d{1,3}(&|$)') THEN regexp_extract(q, '(?:^|&)page=(\d{1,3})', 1)::INT WHEN regexp_matches(p, '/\d{1,3}/?$') THEN regexp_extract(p, '/(\d{1,3})/?$', 1)::INT ELSE 1 END AS page FROM k""")
def x1_canonical_url(spark, d):
    """Canonical URLs and page numbers."""
    u = F.col("url")
    return b.table(spark, d, "pages").select("page_id", urls.canonical_url(u).alias("url"), urls.page_number(u).alias("page"))


HOSTS = ["10.0.0.7", "localhost:80", "127.0.0.1", "169.254.1.1", "172.15.0.1", "172.16.0.1", "172.31.9.9:8080", "172.32.0.1", "192.168.1.1", "192.169.1.1", "224.0.0.1", "8.8.8.8", "256.1.1.1", "0.0.0.0", "news.internal", "a.local.", "2130706433", "0x7f000001", "[::1]", "user:pw@host.com", "news.host.com"]
INNER = {"10.0.0.7", "localhost:80", "127.0.0.1", "169.254.1.1", "172.16.0.1", "172.31.9.9:8080", "192.168.1.1", "224.0.0.1", "256.1.1.1", "0.0.0.0", "news.internal", "a.local.", "2130706433", "0x7f000001", "[::1]", "user:pw@host.com"}


@query(f"""WITH p AS (SELECT page_id, page_id % {len(HOSTS) + 3} AS k, page_id % 6 AS s, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages)
SELECT page_id, CASE WHEN s = 5 THEN 'bad' WHEN s = 4 THEN 'scheme' WHEN k < {len(HOSTS)} THEN CASE WHEN k IN ({', '.join(str(i) for i, h in enumerate(HOSTS) if h in INNER)}) THEN 'inner' END
  WHEN regexp_matches(host, '^(10\\.|localhost)') THEN 'inner' END AS error FROM p""")
def f11_validate_source_url(spark, d):
    """which URLs may be sources, pages' own and those of hosts within."""
    k, url = F.col("page_id") % (len(HOSTS) + 3), F.col("url")
    path = F.regexp_replace(url, "^[a-z]+://[^/]*", "")
    put = F.when(k < len(HOSTS), F.concat(F.lit("https://"), F.element_at(F.array(*map(F.lit, HOSTS)), (k + 1).cast("int")), path)).otherwise(url)
    s = F.col("page_id") % 6
    put = F.when(s == 5, F.lit("no url at all")).when(s == 4, F.regexp_replace(put, "^[a-z]+:", "ftp:")).otherwise(F.concat(F.lit(" "), put))
    error = urls.validate_source_url(F.col("put"))["error"]
    return b.table(spark, d, "pages").select("page_id", put.alias("put")).select("page_id", F.when(error.startswith("올바른"), "bad").when(error.startswith("HTTP"), "scheme").when(error.startswith("내부"), "inner").alias("error"))


@query(f"""WITH {RUNS}, n AS (SELECT *, date_trunc('day', started_at + INTERVAL 9 HOUR) AS day, greatest(5, least(1440, fetched_count)) AS step FROM runs)
SELECT run_id, epoch_ms(CASE WHEN fetched_count > 0 THEN to_timestamp((floor(epoch(started_at) / (step * 60)) + 1) * step * 60)::TIMESTAMP WHEN day > started_at THEN day ELSE day + INTERVAL 24 HOUR END) AS next_at, strftime(started_at + INTERVAL 9 HOUR, '%Y-%m-%d') AS day FROM n""")
def x7_next_runs(spark, d):
    """The next crawl by interval, or by hour (nine in Korea is midnight here) where there is none, and the day in Korea."""
    t = F.col("started_at")
    return b.runs(spark, d).select("run_id", F.unix_millis(dates.next_crawl_at(F.lit(9), F.col("fetched_count"), t)).alias("next_at"), dates.date_kst(t).cast("string").alias("day"))


@query("""SELECT o_orderkey AS id, epoch_ms(make_timestamp(year(o_orderdate), month(o_orderdate), 1, 0, 0, 0) + to_days((o_orderkey % 31)::INT) + to_hours((o_orderkey % 24)::INT) - INTERVAL 9 HOUR) AS t FROM orders""")
def x3_visible_dates(spark, d):
    """Dates in visible text, days beyond a month's end run over."""
    o = b.table(spark, d, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    shown = F.format_string("입력 %d.%d.%d %02d:00 수정", F.year(day), F.month(day), (F.col("o_orderkey") % 31 + 1).cast("int"), (F.col("o_orderkey") % 24).cast("int"))
    early = F.year(day) < 2000
    shown = F.when(early, F.format_string("%04d-%02d-%02dT%02d:00:00+09:00", F.year(day), F.month(day), F.lit(1), (F.col("o_orderkey") % 24).cast("int"))).otherwise(shown)
    t = dates.parse_visible_date(shown, F.lit(datetime(2024, 1, 1)).cast("timestamp"))
    t = F.when(early, t + F.make_dt_interval(days=(F.col("o_orderkey") % 31).cast("int"))).otherwise(t)
    return o.select(F.col("o_orderkey").alias("id"), F.unix_millis(t).alias("t"))


@query(r"""WITH w AS (SELECT doc_id, substr(trim(regexp_replace(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 500) AS title FROM documents)
SELECT doc_id, title, 'https://news.example.com/a/' || doc_id AS url, epoch_ms(TIMESTAMP '2024-01-01' + to_minutes(doc_id) - INTERVAL 9 HOUR) AS published_at FROM w WHERE title <> ''""")
def io2_parse_feed(spark, d):
    """IO2, IO3: documents written as feeds of twenty, RSS and Atom in turn, and read again; items without a title go."""
    line = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    title = F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    atom = F.col("page") % 2 == 1
    id_ = F.col("doc_id").cast("string")
    doc = b.table(spark, d, "documents").select("doc_id", title.alias("title"), at.alias("at"), F.floor(F.col("doc_id") / 20).alias("page"))
    entry = F.concat(F.lit("<entry><title>"), "title", F.lit('</title><link rel="alternate" href="/a/'), id_, F.lit('?utm_source=x"/><updated>'), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00</updated></entry>"))
    item = F.concat(F.lit("<item><title>"), "title", F.lit("</title><link>/a/"), id_, F.lit("?utm_source=x&amp;section=y</link><pubDate>Mon, "), F.date_format("at", "dd MMM yyyy HH:mm:ss"), F.lit(" +0900</pubDate></item>"))
    doc = doc.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.when(atom, entry).otherwise(item).alias("x")))).alias("items"))  # twenty at most
    inner = F.array_join(F.transform("items", lambda i: i["x"]), "\n")
    body = F.when(atom, F.concat(F.lit("<?xml?><feed>"), inner, F.lit("</feed>"))).otherwise(F.concat(F.lit("<rss><channel>"), inner, F.lit("</channel></rss>")))
    pages = doc.select(F.lit("https://news.example.com/rss").alias("url"), body.alias("body")).where(feeds.looks_like_feed(F.col("body")))
    items = feeds.parse_feed(pages, F.lit(datetime(2024, 6, 1)).cast("timestamp"))
    return items.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("doc_id"), "title", "url", F.unix_millis("published_at").alias("published_at"))


@query(r"""WITH i AS (SELECT url AS page, unnest(regexp_extract_all(html, '<li><a href="/([^"]*)">', 1)) AS title FROM pages)
SELECT DISTINCT page, title, regexp_extract(page, '^(https?://[^/?#]+)', 1) || '/' || replace(url_encode(title), '%2C', ',') AS url, epoch_ms(TIMESTAMP '2024-01-15 01:00:00') AS published_at FROM i WHERE length(title) >= 12""")
def io4_parse_list(spark, d):
    """IO4, IO5: items and links of pages, given a date before each anchor."""
    dated = F.regexp_replace("html", "<li><a ", '<li><span class="time">2024.01.15 10:00</span><a title="a title of twelve letters" ')
    items = feeds.parse_news_list(b.table(spark, d, "pages").select("url", dated.alias("html")), F.lit(datetime(2024, 1, 16)).cast("timestamp"))
    return items.select("page", "title", "url", F.unix_millis("published_at").alias("published_at"))


@query(r"""WITH o AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM pages)
SELECT page_id, NOT (regexp_matches(url, '^https?://[^/?#]+/fr/')) AS allowed FROM pages""")
def f12_robots(spark, d):
    """which pages robots files let through, if each forbids /fr/ but for other agents."""
    pages = b.table(spark, d, "pages").select("page_id", "url")
    robots = pages.select(F.lower(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)).alias("origin")).distinct().withColumns({"status": F.lit(200), "text": F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /fr/\nAllow: /f\n")})
    return feeds.robots_filter(pages, feeds.robots_rules(robots, "examplebot")).select("page_id", "allowed")


ENTRIES = [("AAA", "The Company", "US", "one", ["the", "thethe"]), ("BBB", "Der", "KR", "two", ["der", "schen"]), ("CCC", "Que", "US", "one", ["que", "les"]), ("DDD", "Ción", "KR", "three", ["ción", "für"]), ("AAA", "The Company", "US", "one", ["of the"]), ("EEE", "Tion", "US", "two", ["the"])]


def matches_sql(entries: list[tuple], noise: list[str]) -> str:
    """Counts of all aliases, from the longest on, each taking out what it has matched."""
    steps = [", s0 AS (SELECT article_id, " + ", ".join(f"{reduce(lambda t, n: f'replace({t}, {n!r}, chr(32))', noise, c)} AS {c[0]}" for c in ("title", "body")) + " FROM articles)"]
    pairs = sorted(((a, e) for e in entries for a in e[4]), key=lambda p: -len(p[0]))
    for i, (alias, e) in enumerate(pairs):
        count = r"len(regexp_extract_all(lower(' ' || regexp_replace({c}, '([^A-Za-z0-9])', '\1\1', 'g') || ' '), '[^a-z0-9]{a}[^a-z0-9]'))" if alias.isascii() else "(length({c}) - length(replace({c}, '{a}', ''))) // length('{a}')"
        n = [count.format(c=c, a=alias.replace(" ", "  ")) for c in "tb"]
        steps.append(f", c{i} AS (SELECT article_id, t, b, {n[0]} AS nt, {n[1]} AS nb FROM s{i}), s{i + 1} AS (SELECT article_id, CASE WHEN nt > 0 THEN replace(t, '{alias}', ' ') ELSE t END AS t, CASE WHEN nb > 0 THEN replace(b, '{alias}', ' ') ELSE b END AS b FROM c{i})")
    found = " UNION ALL ".join(f"SELECT article_id, {i} AS pos, '{e[0]}' AS symbol, '{e[1]}' AS company, '{e[2]}' AS market, '{e[3]}' AS sector, nt, nb FROM c{i} WHERE nt + nb > 0" for i, (_, e) in enumerate(pairs))
    return "".join(steps) + f""", found AS ({found}),
per AS (SELECT article_id, symbol, min(pos) AS pos, arg_min(company, pos) AS company, arg_min(market, pos) AS market, arg_min(sector, pos) AS sector, sum(nt + nb)::INT AS mentions,
  max(least(100, CASE WHEN nt > 0 THEN 72 ELSE 40 END + least(6 * (nt + nb), 28)))::INT AS relevance FROM found GROUP BY ALL)
SELECT article_id, symbol, company, market, sector, mentions, relevance FROM per QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY relevance DESC, mentions DESC, pos) <= 8"""


@query(f"""WITH {ARTICLES}{matches_sql(ENTRIES, ["thst"])}""")
def t5_match_symbols(spark, d):
    """Symbols mentioned, from a dictionary drawn from the text."""
    return news.article_symbols(news.match_symbols(b.spread(b.articles(spark, d)), ENTRIES, ["thst"]))


@query(f"""WITH {ANALYSIS_SQL.replace("substr(title || '. ' || body, 1, 6500)", "substr(title || '. ' || body, 1, 8000)")},
w AS (SELECT article_id, title, body, regexp_matches(lower(' ' || title || ' '), '[^a-z0-9]the[^a-z0-9]') OR regexp_matches(lower(' ' || body || ' '), '[^a-z0-9]the[^a-z0-9]') AS one, contains(title, 'ción') OR contains(body, 'ción') AS two,
  list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: length(x) > 30)[1:2] AS long FROM articles)
SELECT article_id, CASE WHEN raw > 0 THEN '긍정' WHEN raw < 0 THEN '부정' ELSE '중립' END AS sentiment, greatest(0, least(100, 50 + raw * 11))::INT AS sentiment_score, materiality, event_type,
  CASE WHEN event_type = '실적·가이던스' THEN '중기(1~2분기)' WHEN event_type = '수주·사업계약' THEN '장기(1년+)' WHEN materiality = '낮음' THEN '당일' ELSE '단기(1~4주)' END AS impact_horizon,
  CASE WHEN one AND two THEN 'one, two' WHEN one THEN 'one' WHEN two THEN 'two' ELSE '' END AS sectors, CASE WHEN one OR two THEN CASE WHEN one AND two THEN 'one, two' WHEN one THEN 'one' ELSE 'two' END || ' 업종에 관련된 보도입니다.' ELSE '특정 업종을 지목하기 어려운 일반 보도입니다.' END AS market_view,
  one::INT + two::INT AS n_symbols, sha256(substr(CASE WHEN len(long) > 0 THEN array_to_string(long, ' ') WHEN body <> '' THEN body ELSE title END, 1, 400)) AS summary FROM m JOIN w USING (article_id)""")
def t9_rule_insight(spark, d):
    """Insights by rules; replies without JSON leave them as they are."""
    a = news.match_symbols(b.articles(spark, d), [("AAA", "The Company", "US", "one", ["the"]), ("BBB", "Ción", "KR", "two", ["ción"])])
    base = news.rule_insight(a, news.keywords(b.articles(spark, d)), GOOD, BAD, WEIGHTY)
    replies = b.table(spark, d, "conversations").where("role = 'assistant'").groupBy((F.col("conv_id") % 100).alias("article_id")).agg(F.min("text").alias("reply")).withColumns({"engine": F.lit("llm"), "model": F.lit("m")})
    out = news.merge_llm_insight(base, replies)
    names = F.array_join(F.array_sort("sectors"), ", ")
    view = F.when(F.size("sectors") > 1, F.concat(names, F.lit(" 업종에 관련된 보도입니다."))).otherwise(F.col("market_view"))
    return out.select("article_id", "sentiment", "sentiment_score", "materiality", "event_type", "impact_horizon", names.alias("sectors"), view.alias("market_view"), "n_symbols", F.sha2("summary", 256).alias("summary"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 12 AS form, (o_orderdate::DATE + INTERVAL 10 YEAR)::DATE AS d, (o_orderkey % 24)::INT AS h, (o_orderkey % 60)::INT AS m FROM orders),
t AS (SELECT *, d::TIMESTAMP + to_hours(h) + to_minutes(m) AS t FROM o)
SELECT id, epoch_ms(CASE form WHEN 0 THEN t - INTERVAL 9 HOUR WHEN 1 THEN t WHEN 2 THEN t WHEN 3 THEN t - INTERVAL 9 HOUR WHEN 4 THEN t - INTERVAL 9 HOUR WHEN 5 THEN d::TIMESTAMP - INTERVAL 9 HOUR WHEN 6 THEN t + INTERVAL 5 HOUR WHEN 7 THEN t
  WHEN 8 THEN make_timestamp(CASE WHEN make_timestamp(2008, month(d), day(d), h, m, 0) - INTERVAL 9 HOUR > TIMESTAMP '2008-08-11 12:00:00' THEN 2007 ELSE 2008 END, month(d), day(d), h, m, 0) - INTERVAL 9 HOUR
  WHEN 9 THEN TIMESTAMP '2008-08-10 12:00:00' - to_minutes(m) WHEN 11 THEN t - INTERVAL 210 MINUTE END) AS t FROM t""")
def x5_feed_dates(spark, d):
    """Dates as feeds write them, in all their forms."""
    day = F.add_months(F.col("o_orderdate").cast("date"), 120).cast("timestamp")
    at = day + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"), mins=(F.col("o_orderkey") % 60).cast("int"))
    shown = lambda form: F.date_format(at, form)
    forms = [
        shown("EEE, dd MMM yyyy HH:mm:ss '+0900'"), shown("EEEE, d MMMM yy HH:mm 'GMT'"), shown("yyyy-MM-dd'T'HH:mm:ss'Z'"), shown("yyyy-MM-dd HH:mm:ss'+09:00'"), shown("yyyy-MM-dd HH:mm"), shown("'<b>'yyyy.M.d'</b>'"),
        shown("dd MMM yyyy HH:mm:ss 'EST'"), shown("MMM d, yyyy H:mm:ss 'UTC (now)'"), shown("M'월' d'일' H'시' m'분'"), F.concat(shown("m"), F.lit("분 전")), shown("'item 'd'-'M"), shown("EEE, dd MMM yyyy HH:mm:ss '+0330'"),
    ]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 12 + 1).cast("int"))
    out = dates.with_feed_date(b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("shown")), "shown", F.lit(datetime(2008, 8, 10, 12)).cast("timestamp"), "at")
    return out.select("id", F.unix_millis("at").alias("t"))
