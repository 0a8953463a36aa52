"""Queries over raw files written from the standard tables and read again, over model replies, and over what single operators add to others."""

from __future__ import annotations

import io
import zipfile
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import companies as comp
from tidemark.operators import filings, indicators, news, stock_news
from tidemark.plans import filings as filing_plans
from tidemark.plans import ranking as ranking_plans
from tidemark.plans.registry import query, rounded
from tidemark.sources.tables import folder
from tidemark.sources import bindings as b
from tidemark.sources import feeds, tables
from tidemark.sources.bindings import ARTICLES, BRIDGE
from tidemark.streaming import jobs


def zipped(text: Column, name: str, encoding: str) -> Column:
    """A zip archive with one text file."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(name, t.encode(encoding))
            out.append(buffer.getvalue())
        return pd.Series(out)

    return run(text)


def gathered(df: DataFrame, by: Column, line: Column, sep: str = "") -> DataFrame:
    """(k, text): lines of each group, of bounded size, in order of id."""
    rows = df.select(by.alias("k"), "id", line.alias("line")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("rows"))
    return rows.select("k", F.array_join(F.transform("rows", lambda r: r["line"]), sep).alias("text"))


@query("""SELECT lpad(s_suppkey::VARCHAR, 10, '0') AS key, 'T' || s_suppkey AS ticker, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'T' || s_suppkey || '-B' ELSE '' END AS aliases FROM supplier""")
def io7_company_tickers(spark, d):
    """IO7: suppliers as ticker files of five hundred companies, a third with a second share, read again."""
    k = F.col("s_suppkey")
    s = b.table(spark, d, "supplier").withColumn("id", k)
    row = lambda at, ticker: F.concat(F.lit('"'), at.cast("string"), F.lit('":{"cik_str":'), k.cast("string"), F.lit(',"ticker":"t'), k.cast("string"), F.lit(ticker + '","title":"'), F.col("s_name"), F.lit('"}'))
    line = F.concat(row(k * 2, ""), F.when(k % 3 == 0, F.concat(F.lit(","), row(k * 2 + 1, "-b"))).otherwise(F.lit("")))
    raw = gathered(s, F.floor(k / 500), line, ",").select(F.concat(F.lit("{"), "text", F.lit("}")).alias("json"))
    return comp.company_tickers(raw, least=1).select("key", "ticker", "name", F.array_join("aliases", ",").alias("aliases"))


@query("""SELECT lpad(s_suppkey::VARCHAR, 8, '0') AS key, lpad(s_suppkey::VARCHAR, 6, '0') AS ticker, s_name AS name, upper(s_name) AS name_en,
  (SELECT max(strftime(DATE '2025-01-01' + (s_suppkey % 300)::INT, '%Y-%m-%d')) FROM supplier WHERE s_suppkey % 4 <> 0) AS as_of FROM supplier WHERE s_suppkey % 4 <> 0""")
def io8_corp_codes(spark, d):
    """IO8: suppliers as zipped XML lists, a quarter of them unlisted, read again."""
    k = F.col("s_suppkey")
    tag = lambda name, v: F.concat(F.lit(f"<{name}>"), v, F.lit(f"</{name}>\n"))
    day = F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (k % 300).cast("int")), "yyyyMMdd")
    code = F.when(k % 4 != 0, F.lpad(k.cast("string"), 6, "0")).otherwise(F.lit(" "))
    line = F.concat(F.lit("<list>\n"), tag("corp_code", F.lpad(k.cast("string"), 8, "0")), tag("corp_name", F.col("s_name")), tag("corp_eng_name", F.upper("s_name")), tag("stock_code", code), tag("modify_date", day), F.lit("</list>\n"))
    raw = gathered(b.table(spark, d, "supplier").withColumn("id", k), F.floor(k / 500), line)
    files = raw.select(F.col("k").cast("string").alias("path"), zipped(F.concat(F.lit("<result>\n"), "text", F.lit("</result>")), "CORPCODE.xml", "utf-8").alias("content"))
    return comp.corp_codes(comp.zipped_records(files, "</list>"), least=1)


@query("""WITH p AS (SELECT lpad(p_partkey::VARCHAR, 6, '0') AS key, '종목 ' || p_partkey || CASE WHEN p_partkey % 11 = 0 THEN ' 스팩' ELSE '' END AS name, p_partkey AS k FROM part)
SELECT key, name, CASE WHEN k % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS exchange, CASE WHEN k % 11 = 0 THEN 2 WHEN k % 7 = 0 THEN 1 ELSE 0 END AS rank_hint, CASE WHEN k % 13 = 0 THEN 0 ELSE k * 3 END::DOUBLE AS market_cap FROM p WHERE k % 5 <> 0 AND k % 17 <> 0""")
def io9_stock_master(spark, d):
    """IO9: parts as fixed-width rows of two markets, read again: other kinds of paper and halted ones go."""
    k = F.col("p_partkey")
    parts = b.table(spark, d, "part").withColumn("id", k)
    masters = []
    for i, (exchange, at) in enumerate(comp.MASTERS.items()):
        cap = F.when(k % 13 == 0, F.lit("x")).otherwise(F.lpad((k * 3).cast("string"), at["market_cap"][1] - at["market_cap"][0], "0"))
        put = {"group": F.when(k % 5 == 0, "EF").otherwise("ST"), "halted": F.when(k % 17 == 0, "Y").otherwise("N"), "preferred": F.when(k % 7 == 0, "1").otherwise("0"), "market_cap": cap}
        tail, end = [], 0
        for name, value in put.items():
            tail += [F.lit(" " * (at[name][0] - end)), F.rpad(value, at[name][1] - at[name][0], " ")]
            end = at[name][1]
        code = F.lpad(k.cast("string"), 6, "0")
        name = F.concat(F.lit("종목 "), k.cast("string"), F.when(k % 11 == 0, " 스팩").otherwise(""))
        line = F.concat(F.rpad(code, 9, " "), F.rpad(F.concat(F.lit("KR7"), code), 12, " "), name, *tail, F.lit(" " * (at["tail"] - end)))
        raw = gathered(parts.where(k % 2 == i), F.floor(k / 1000), line, "\n")
        files = raw.select(F.col("k").cast("string").alias("path"), zipped(F.col("text"), f"{exchange.lower()}_code.mst", comp.MASTER_ENCODING).alias("content"))
        masters.append(comp.stock_master(comp.zipped_records(files, "\n", comp.MASTER_ENCODING, ".mst"), exchange))
    return comp.stock_masters(masters, least=1).select("key", "name", "exchange", "rank_hint", "market_cap")


@query(f"WITH {filing_plans.FACTS_SQL} SELECT cik, period, {', '.join(f'round({c}, 6) AS {c}' for c in filing_plans.RATIOS)} FROM x WHERE coalesce({', '.join(filing_plans.RATIOS)}) IS NOT NULL")
def io10_sec_facts(spark, d):
    """IO10: orders as company fact files, one a customer, read and made into ratios."""
    k = F.col("o_orderkey")
    concept = F.when(k % 3 == 0, "Revenues").when(k % 3 == 1, "NetIncomeLoss").otherwise("StockholdersEquity")
    fact = F.struct(F.lit("10-K").alias("form"), F.year("o_orderdate").cast("string").alias("end"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"), F.col("o_totalprice").alias("val"))
    per = b.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cik"), concept.alias("concept")).agg(F.transform(F.sort_array(F.collect_list(F.struct(k, fact.alias("f")))), lambda x: x["f"]).alias("rows"))
    body = F.map_from_entries(F.collect_list(F.struct("concept", F.struct(F.create_map(F.lit("USD"), F.col("rows")).alias("units")))))
    raw = per.groupBy("cik").agg(F.to_json(F.struct(F.create_map(F.lit("us-gaap"), body).alias("facts"))).alias("json"))
    caps = b.table(spark, d, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_acctbal").alias("market_cap"))
    return rounded(filings.sec_fundamentals(filings.sec_facts(raw), caps).select("cik", "period", *filing_plans.RATIOS), filing_plans.RATIOS)


@query("""WITH f AS (SELECT o_custkey AS cik, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT cik, pos::INT AS pos, CASE k % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '8-K' ELSE '6-K' END AS form, day AS filed_at, day AS period_of_report, 'A-' || k AS accession, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/A' || k || CASE WHEN k % 2 = 0 THEN '/d.htm' ELSE '' END AS url FROM f WHERE pos < n - 1""")
def io11_submissions(spark, d):
    """IO11, X21: orders as submission files of parallel lists, the shortest of which lacks the last entry, read again with their addresses."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    f = F.struct(k, F.when(k % 3 == 0, "10-K").when(k % 3 == 1, "8-K").otherwise("6-K").alias("form"), day.alias("day"), F.concat(F.lit("A-"), k.cast("string")).alias("no"), F.when(k % 2 == 0, "d.htm").otherwise("").alias("doc"))
    per = b.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cik")).agg(F.sort_array(F.collect_list(f)).alias("r"))
    part = lambda n: F.transform("r", lambda x: x[n])
    recent = F.struct(part("form").alias("form"), part("day").alias("filingDate"), F.transform("r", lambda x: F.lit("")).alias("reportDate"), F.slice(part("no"), F.lit(1), F.size("r") - 1).alias("accessionNumber"), part("doc").alias("primaryDocument"))
    raw = per.where(F.size("r") > 1).select("cik", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    return filings.submissions(raw)


@query("""SELECT c_custkey AS company, 'DART' AS source, '2024-12-31' AS period, round(CASE WHEN c_acctbal > 0 THEN c_acctbal / 200 END, 6) AS trailing_pe, round(CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000 END, 6) AS price_to_book,
  round(20000.0::DOUBLE / (c_custkey + 2000), 6) AS profit_margin_pct, round(CASE WHEN c_custkey % 4 <> 0 THEN ((c_custkey + 2000) / 1600.0::DOUBLE - 1) * 100 END, 6) AS revenue_growth_pct FROM customer""")
def io12_dart_accounts(spark, d):
    """IO12, W18: customers as statement files, read and made into ratios: consolidated statements win, dashes are missing."""
    k = F.col("c_custkey")
    row = lambda name, div, now, before: F.struct(F.lit(name).alias("account_nm"), F.lit(div).alias("fs_div"), now.alias("thstrm_amount"), before.alias("frmtrm_amount"))
    money = F.format_number((k + 2000).cast("long"), 0)
    rows = F.array(row("매출액", "OFS", F.lit("9"), F.lit("9")), row("매출액", "CFS", money, F.when(k % 4 == 0, "-").otherwise("1,600")), row("당기순이익", "CFS", F.lit(" 200 "), F.lit("")), row("자본총계", "CFS", F.lit("1,000"), F.lit("")), row("other", "CFS", F.lit("1"), F.lit("1")))
    c = b.table(spark, d, "customer")
    raw = c.select(k.alias("company"), F.to_json(F.struct(rows.alias("list"))).alias("json"))
    caps = c.select(k.alias("company"), F.col("c_acctbal").alias("market_cap"))
    return rounded(filings.dart_fundamentals(filings.dart_accounts(raw), "2024", caps), filing_plans.RATIOS)


@query("""WITH e AS (SELECT event_id AS k, CASE WHEN event_id % 2 = 0 THEN 'Naver' ELSE 'GDELT' END AS provider, date_trunc('second', ts::TIMESTAMP) AS seen FROM events)
SELECT provider, 'A & B ' || k AS title, CASE WHEN provider = 'Naver' THEN 'x y' ELSE '' END AS summary, CASE WHEN k % 3 = 0 THEN '' ELSE 'https://n.com/' || k END AS url, epoch_ms(seen) AS observed_at FROM e WHERE seen BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND k % 7 <> 0""")
def io13_provider_news(spark, d):
    """IO13: events as the payloads of two providers, one with marked-up text, the other with compact dates."""
    k = F.col("event_id")
    e = b.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    title = F.when(k % 7 == 0, "<b> </b>").otherwise(F.concat(F.lit("<b>A</b> &amp; B "), k.cast("string")))
    link = F.concat(F.when(k % 3 == 0, "ftp://n.com/").otherwise("https://n.com/"), k.cast("string"))
    since, until = (F.lit(datetime(2024, 1, x)).cast("timestamp") for x in (5, 20))
    one = e.where(k % 2 == 0).select(title.alias("title"), F.lit("x&nbsp;<i>y</i>").alias("summary"), link.alias("link"), F.concat(F.lit("Mon, "), F.date_format("at", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("date"))
    two = e.where(k % 2 == 1).select(title.alias("title"), F.lit(None).cast("string").alias("summary"), link.alias("link"), F.date_format("at", "yyyyMMdd'T'HHmmss'Z'").alias("date"))
    out = stock_news.normalize_provider_news(one, "Naver", since, until).unionByName(stock_news.normalize_provider_news(two, "GDELT", since, until))
    return out.select("provider", "title", "summary", "url", F.unix_millis("observed_at").alias("observed_at"))


@query("""SELECT page_id, 'https://n.com/list/' || page_id || '?page=' || (page_id % 5 + 1) AS url, CASE page_id % 3 WHEN 0 THEN 'https://n.com/next/' || page_id WHEN 1 THEN 'https://n.com/list/' || page_id || '?page=' || (page_id % 5 + 2) ELSE '' END AS next_page_url,
  CASE WHEN page_id % 2 = 0 THEN 'https://n.com/feed.xml' ELSE '' END AS feed_url FROM pages""")
def io5_discover_links(spark, d):
    """IO5: list pages, one a page, with a link to the next, a pager, or a number that leads elsewhere."""
    k = F.col("page_id")
    at = (k % 5 + 1).cast("int")
    link = lambda n: F.concat(F.lit('<a class="p" href="?page='), n.cast("string"), F.lit('"> '), n.cast("string"), F.lit(" </a>"))
    more = F.when(k % 3 == 0, F.concat(F.lit('<link rel="next" href="/next/'), k.cast("string"), F.lit('">'))).when(k % 3 == 1, F.concat(link(at), link(at + 1), link(at + 2))).otherwise(F.concat(F.lit('<a href="/other?page=9">'), (at + 1).cast("string"), F.lit("</a>")))
    feed = F.when(k % 2 == 0, '<link type="application/rss+xml" href="/feed.xml?utm_source=a">').otherwise("")
    pages = b.table(spark, d, "pages").select(k, F.concat(F.lit("https://n.com/list/"), k.cast("string"), F.lit("?page="), at.cast("string")).alias("url"), F.concat(F.lit("<html><head>"), feed, F.lit("</head>"), more, F.lit("</html>")).alias("html"))
    return pages.select("page_id", "url").join(feeds.discover_links(pages), "url")


@query(f"""WITH {ARTICLES}, r AS (SELECT article_id, title, body, article_id % 6 AS k, CASE WHEN article_id % 3 = 0 THEN '' ELSE 'base ' || article_id END AS s0 FROM articles)
SELECT article_id, CASE WHEN k IN (1, 4) THEN trim(substr('said ' || article_id, 1, 800)) ELSE s0 END AS summary, CASE WHEN k IN (1, 4) THEN 'a,b' ELSE 'x' END AS keywords, CASE WHEN k = 1 THEN '긍정' ELSE '중립' END AS sentiment,
  CASE WHEN k = 1 THEN least(100, article_id % 130) WHEN k = 4 THEN 41 ELSE 50 END::INT AS sentiment_score, CASE WHEN k = 1 THEN '높음' ELSE '낮음' END AS materiality, CASE WHEN k = 1 THEN 'kind' ELSE 'none' END AS event_type,
  CASE WHEN k = 1 THEN 8 WHEN k = 4 THEN -2 ELSE 0 END::INT AS score_adjustment, CASE WHEN k IN (1, 4) THEN 'llm' ELSE 'rule' END AS engine FROM r""")
def x25_merge_replies(spark, d):
    """Replies of models, fenced, with prose around, broken or without JSON, merged into insights by rules, field by field."""
    k = F.col("article_id")
    a = b.articles(spark, d)
    base = a.select("article_id", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("base "), k.cast("string"))).alias("summary"), F.array(F.lit("x")).alias("keywords"), F.array(F.lit("s")).alias("sectors"), F.array(F.lit("e")).alias("evidence"), F.lit("중립").alias("sentiment"), F.lit(50).alias("sentiment_score"), F.lit("낮음").alias("materiality"), F.lit("none").alias("event_type"), F.lit("당일").alias("impact_horizon"), F.lit("v").alias("market_view"), F.lit(0).alias("score_adjustment"), F.lit("rule").alias("engine"), F.lit("").alias("model"))
    id_ = k.cast("string")
    good = F.concat(F.lit('Sure!\n```json\n{"summary": " said '), id_, F.lit('", "keywords": ["a", " ", "b"], "sentiment": "긍정", "sentimentScore": '), (k % 130).cast("string"), F.lit(', "materiality": "높음", "eventType": " kind ", "scoreAdjustment": 99}\n```'))
    half = F.concat(F.lit('{"summary": "said '), id_, F.lit('", "keywords": ["a", "b"], "sentiment": "great", "sentimentScore": "40.5", "materiality": 3, "eventType": " ", "scoreAdjustment": -2.5}'))
    reply = F.when(k % 6 == 1, good).when(k % 6 == 4, half).when(k % 6 == 2, "}{").when(k % 6 == 3, "no braces here").when(k % 6 == 5, '{"summary": "cut off').otherwise("")
    replies = a.select("article_id", reply.alias("reply"), F.lit("llm").alias("engine"), F.lit("m").alias("model"))
    out = news.merge_llm_insight(base, replies)
    return out.select("article_id", "summary", F.array_join("keywords", ",").alias("keywords"), "sentiment", "sentiment_score", "materiality", "event_type", "score_adjustment", "engine")


@query("""WITH e AS (SELECT o_custkey AS c, list(DISTINCT 'E' || (o_orderkey % 4) ORDER BY 'E' || (o_orderkey % 4)) AS known FROM orders GROUP BY 1)
SELECT c_custkey::VARCHAR AS symbol, round(c_acctbal, 6) AS price, CASE WHEN c_custkey % 2 = 0 THEN '부정' ELSE '중립' END AS stance, CASE WHEN c_custkey % 2 = 0 THEN 'text ' || c_custkey ELSE '' END AS narrative, CASE WHEN c_custkey % 2 = 0 THEN 's1,s2' ELSE '' END AS strengths,
  CASE WHEN c_custkey % 2 = 0 THEN array_to_string(list_filter(['E3', 'E1', 'E9', 'E0'], lambda x: list_contains(coalesce(known, []), x)), ',') ELSE '' END AS evidence_ids FROM customer LEFT JOIN e ON c = c_custkey""")
def x26_merge_report(spark, d):
    """Narratives of models beside numbers that they can't change; cited ids must be known."""
    k = F.col("c_custkey")
    c = b.table(spark, d, "customer")
    quant = c.select(k.cast("string").alias("symbol"), F.col("c_acctbal").alias("price"))
    reply = F.when(k % 2 == 0, F.concat(F.lit('{"price": 1, "stance": "부정", "summary": " text '), k.cast("string"), F.lit('", "strengths": ["s1", "", "s2"], "risks": [], "evidence_ids": ["E3", "E1", "E9", "E0", "E3"]}'))).otherwise("{")
    known = b.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.concat(F.lit("E"), (F.col("o_orderkey") % 4).cast("string")).alias("id"))
    out = news.merge_report(quant, c.select(k.cast("string").alias("symbol"), reply.alias("reply")), known)
    return rounded(out.select("symbol", "price", "stance", "narrative", F.array_join("strengths", ",").alias("strengths"), F.array_join("evidence_ids", ",").alias("evidence_ids")), ["price"])


@query("""WITH e AS (SELECT o_custkey AS c, list(DISTINCT o_orderpriority || '|' || o_orderstatus ORDER BY o_orderpriority || '|' || o_orderstatus) AS ids FROM orders GROUP BY 1)
SELECT c_custkey::VARCHAR AS symbol, sha256('{"symbol":"' || c_custkey || '","day":"2024-01-02","price":"' || printf('%.3e', (c_custkey * 37.5123::DOUBLE)) || '","period":"2023","ids":[' || coalesce(array_to_string(list_transform(ids, lambda x: '"' || x || '"'), ','), '') || ']}') AS digest FROM customer LEFT JOIN e ON c = c_custkey""")
def x28_fingerprints(spark, d):
    """What tells whether a report would say the same."""
    k = F.col("c_custkey")
    s = b.table(spark, d, "customer").select(k.cast("string").alias("symbol"), F.lit("2024-01-02").alias("observed_at"), (k * 37.5123).alias("price"), F.lit("2023").alias("financial_period"))
    e = b.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderpriority").alias("id"), F.col("o_orderstatus").alias("summary"))
    return news.evidence_fingerprint(s, e)


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'quota' WHEN 1 THEN 'quota' WHEN 2 THEN 'auth' WHEN 3 THEN 'transient' WHEN 4 THEN 'quota' WHEN 5 THEN 'request' WHEN 6 THEN 'transient' ELSE 'request' END AS kind FROM events""")
def x29_failures(spark, d):
    """Kinds of failures."""
    status = F.element_at(F.array(*map(F.lit, [429, 402, 403, 503, 400, 400, 408, 404])), (F.col("event_id") % 8 + 1).cast("int"))
    detail = F.when(F.col("event_id") % 8 == 4, "Quota exceeded").otherwise("bad field")
    return b.table(spark, d, "events").select("event_id", stock_news.classify_failure(status, detail).alias("kind"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'symbol' WHEN p_partkey % 7 = 0 THEN 'quality' WHEN p_partkey % 5 = 0 THEN 'drawdown' WHEN p_partkey % 4 = 0 THEN 'stale_ratio' WHEN (SELECT count(*) FROM part q WHERE q.p_partkey % 10 = part.p_partkey % 10) > 150 THEN 'too many rows' END AS error FROM part""")
def x30_validate_candidates(spark, d):
    """Rows of ranking requests that are refused, and requests that are too long."""
    k = F.col("p_partkey")
    n = {c: F.lit(1.0) for c in ("price", "atr_20", "value", "momentum", "revisions", "news", "liquidity", "beta")}
    n |= {"quality": F.when(k % 7 == 0, float("nan")).otherwise(1.0), "drawdown": F.when(k % 5 == 0, -1.0).otherwise(1.0), "stale_ratio": F.when(k % 4 == 0, 1.5).otherwise(0.5)}
    rows = b.table(spark, d, "part").select(k.alias("id"), (k % 10).alias("request_id"), F.when(k % 9 == 0, " ").otherwise("S").alias("symbol"), *[c.alias(name) for name, c in n.items()])
    return indicators.validate_candidates(rows, most=150).select("id", "error")


@query("""SELECT DISTINCT q.query, s.symbol FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN ' t' || c_custkey WHEN 1 THEN upper('Supplier#' || c_custkey) WHEN 2 THEN 'sup ' || c_custkey ELSE 'none ' || c_custkey END AS query, CASE WHEN c_custkey % 4 < 3 THEN c_custkey END AS k FROM customer) q
LEFT JOIN (SELECT s_suppkey AS k, 'T' || s_suppkey AS symbol FROM supplier) s USING (k)""")
def t7_lookup_symbol(spark, d):
    """Symbols by symbol, name or alias, without case."""
    k = F.col("s_suppkey")
    dictionary = b.table(spark, d, "supplier").select(k.alias("pos"), F.concat(F.lit("T"), k.cast("string")).alias("symbol"), F.concat(F.lit("Supplier#"), k.cast("string")).alias("name"), F.array(F.concat(F.lit("Sup "), k.cast("string"))).alias("aliases"))
    c = F.col("c_custkey")
    text = c.cast("string")
    q = F.when(c % 4 == 0, F.concat(F.lit(" t"), text)).when(c % 4 == 1, F.upper(F.concat(F.lit("Supplier#"), text))).when(c % 4 == 2, F.concat(F.lit("sup "), text)).otherwise(F.concat(F.lit("none "), text))
    return news.lookup_symbol(b.table(spark, d, "customer").select(q.alias("query")), dictionary)


@query(f"""WITH {ARTICLES}, {BRIDGE}, m AS (SELECT article_id, symbol AS s, mentions * 20 AS relevance FROM bridge QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY symbol) = 1)
SELECT article_id, CASE WHEN article_id % 3 = 0 THEN '긍정' ELSE sentiment END AS sentiment, CASE WHEN article_id % 3 = 0 THEN coalesce(CASE WHEN article_id % 2 = 0 THEN s END, 'GENERAL') ELSE symbol END AS symbol,
  CASE WHEN article_id % 3 = 0 THEN coalesce(CASE WHEN article_id % 2 = 0 THEN relevance END, 40) END::INT AS relevance, CASE WHEN article_id % 3 = 0 THEN '완료' ELSE insight_status END AS insight_status, CASE WHEN article_id % 3 = 0 THEN length(substr(body, 1, 500)) END AS summary_chars FROM articles LEFT JOIN m USING (article_id)""")
def t13_apply_insight(spark, d):
    """Articles with what their insights say, the best symbol and its relevance."""
    a = b.articles(spark, d)
    k = F.col("article_id")
    found = a.where(k % 3 == 0).select("article_id", F.lit("긍정").alias("sentiment"), F.lit(70).alias("sentiment_score"), F.lit("높음").alias("materiality"), F.lit("e").alias("event_type"), F.lit(1).alias("score_adjustment"), F.col("body").alias("summary"))
    m = b.bridge(spark, d).where(k % 2 == 0).groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("symbol", (F.col("mentions") * 20).alias("relevance")))).alias("matches"))
    out = news.apply_insight(a, found, m)
    return out.select("article_id", "sentiment", "symbol", "relevance", "insight_status", F.length("analysis_summary").cast("long").alias("summary_chars"))


@query(f"""WITH {ARTICLES} SELECT article_id, article_id % 4 + (article_id % 5 = 0)::INT AS attempts, CASE WHEN article_id % 5 = 0 THEN CASE WHEN article_id % 4 + 1 >= 3 THEN '오류' ELSE '대기' END ELSE insight_status END AS insight_status FROM articles""")
def st3_retry_outcomes(spark, d):
    """ST3: articles whose analysis failed wait again, or are given up at the third attempt."""
    k = F.col("article_id")
    a = b.articles(spark, d).withColumn("attempts", (k % 4).cast("int"))
    return news.retry_outcomes(a, a.where(k % 5 == 0)).select("article_id", "attempts", "insight_status")


@query("""SELECT state, count(*) AS n, count(*) FILTER (state = '완료') AS parsed FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN '변경 없음' WHEN 1 THEN '오류' ELSE '완료' END AS state FROM orders) GROUP BY 1""")
def st8_unchanged(spark, d):
    """ST8: pages that haven't changed give a state and no rows."""
    k = F.col("o_orderkey") % 5
    pages, state = jobs.fetched_items(b.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.when(k == 0, 304).when(k == 1, 500).otherwise(200).alias("status"), F.lit("x").alias("body")))
    return state.join(pages.select("source_id", F.lit(1).alias("one")), "source_id", "left").groupBy("state").agg(F.count("*").alias("n"), F.count("one").alias("parsed"))


@query("""WITH i AS (SELECT event_id AS seq, 'ARM' || (user_id % 20) AS symbol, CASE event_id % 3 WHEN 0 THEN 'DB' WHEN 1 THEN 'Naver' ELSE 'GDELT' END AS provider, event_id % 500 AS u, ts::TIMESTAMP AS ts, CASE WHEN event_id % 2 = 0 THEN value END AS score FROM events),
f AS (SELECT *, first_value(provider) OVER w AS fp, bool_or(provider = 'DB' AND score IS NOT NULL) OVER (PARTITION BY symbol, u) AS has FROM i WINDOW w AS (PARTITION BY symbol, u ORDER BY seq)),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol, u ORDER BY CASE WHEN fp <> 'DB' AND has THEN CASE WHEN provider = 'DB' AND score IS NOT NULL THEN 0 ELSE 1 END ELSE 0 END, seq) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, 'stock-news:' || substr(sha256('https://x.com/' || u), 1, 32)) AS rank FROM k)
SELECT symbol, provider, count(*) AS fetched, coalesce(any_value(n), 0) AS accepted FROM i LEFT JOIN (SELECT symbol, provider, count(*) AS n FROM r WHERE rank <= 12 GROUP BY 1, 2) a USING (symbol, provider) GROUP BY 1, 2""")
def a14_provider_counts(spark, d):
    """What each provider gave and what of it was chosen."""
    return stock_news.select_stock_news(*filing_plans.stock_items(spark, d))[1]


PANEL_KEYS = {"추세·모멘텀·위험": ["ma_20", "ma_60", "ma_100", "atr_20", "volatility", "drawdown", "beta"], "가치평가": ["trailing_pe", "price_to_book"], "수익성·성장": ["profit_margin_pct", "revenue_growth_pct"]}
PANEL_SQL = f"""{ranking_plans.SNAPSHOT_SQL}, {ranking_plans.FUNDAMENTALS_SQL}, m AS (
  SELECT symbol, unnest(['ma_20', 'ma_60', 'ma_100', 'atr_20', 'volatility', 'drawdown', 'trailing_pe', 'price_to_book', 'profit_margin_pct', 'revenue_growth_pct', 'beta']) AS key,
    unnest([ma_20, ma_60, ma_100, atr_20, volatility_20d_pct, max_drawdown_1y_pct, CASE WHEN trailing_pe > 0 THEN trailing_pe END, CASE WHEN price_to_book > 0 THEN price_to_book END, profit_margin_pct, revenue_growth_pct, NULL]) AS value FROM snapshot LEFT JOIN fundamentals USING (symbol))"""


@query(f"WITH {PANEL_SQL} SELECT symbol, CASE WHEN key IN ('trailing_pe', 'price_to_book') THEN '가치평가' WHEN key LIKE '%_pct' THEN '수익성·성장' ELSE '추세·모멘텀·위험' END AS grp, count(*) FILTER (value IS NULL) AS missing FROM m GROUP BY 1, 2")
def a17_missing_counts(spark, d):
    """How many indicators of a group have no value."""
    return indicators.missing_counts(ranking_plans.panel(spark, d).where(F.col("key").isin(sum(PANEL_KEYS.values(), []))))


@query(f"WITH {PANEL_SQL} SELECT symbol, key, round(value, 4) AS value FROM m WHERE value IS NOT NULL")
def x27_compact_panel(spark, d):
    """X27, IO17: compact panels written as JSON and read again: the indicators that have values."""
    panel = ranking_plans.panel(spark, d).where(F.col("key").isin(sum(PANEL_KEYS.values(), [])))
    written = indicators.to_panel_json(indicators.compact_panel(panel), "symbol")
    read = written.select("symbol", F.inline(F.from_json("json", "metrics array<struct<key:string,value:double>>")["metrics"]))
    return rounded(read, ["value"], 4)


@query("""WITH c AS (SELECT 's' || (c_custkey % 10) AS query FROM customer GROUP BY 1), k AS (SELECT query, 'KR' AS market, lpad(s_suppkey::VARCHAR, 10, '0') AS key, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN 'S' || s_suppkey = upper(query) THEN 0 ELSE 1 END, s_suppkey % 3, length('n' || s_suppkey), lpad(s_suppkey::VARCHAR, 10, '0')) AS r FROM supplier JOIN c ON starts_with('S' || s_suppkey, upper(query))),
u AS (SELECT query, 'US' AS market, 'P' || p_partkey AS key, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN 'S' || p_partkey = upper(query) THEN 0 ELSE 1 END, length('p' || p_partkey), 'P' || p_partkey) AS r FROM part JOIN c ON starts_with('S' || p_partkey, upper(query))),
a AS (SELECT * FROM k WHERE r <= 8 UNION ALL SELECT * FROM u WHERE r <= 4)
SELECT query, rank, market, key FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY market, r)::INT AS rank FROM a) WHERE rank <= 8""")
def k7_search_symbols(spark, d):
    """K7: Korean and American hits of a search, merged."""
    s, p = F.col("s_suppkey").cast("string"), F.col("p_partkey").cast("string")
    kr = b.table(spark, d, "supplier").select(F.lpad(s, 10, "0").alias("key"), F.concat(F.lit("S"), s).alias("ticker"), F.concat(F.lit("n"), s).alias("name"), (F.col("s_suppkey") % 3).alias("rank_hint"))
    us = b.table(spark, d, "part").select(F.concat(F.lit("P"), p).alias("key"), F.concat(F.lit("S"), p).alias("ticker"), F.concat(F.lit("p"), p).alias("name"))
    q = b.table(spark, d, "customer").select(F.concat(F.lit("s"), (F.col("c_custkey") % 10).cast("string")).alias("query"))
    return comp.search_symbols(q, kr, us)


@query("""WITH s AS (SELECT lpad(s_suppkey::VARCHAR, 10, '0') AS key, s_suppkey AS k FROM supplier), q AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'twin' || (c_custkey % 5) WHEN 1 THEN 'nick ' || (c_custkey % 50) ELSE 'middle' || (c_custkey % 50) || 'X' END AS query, c_custkey % 3 AS kind, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 ELSE c_custkey % 50 END AS k FROM customer)
SELECT query, CASE WHEN kind > 0 THEN s.key END AS key, CASE WHEN kind = 1 AND s.key IS NOT NULL THEN 'alias' WHEN kind = 2 AND s.key IS NOT NULL THEN 'part' END AS method, CASE WHEN kind = 0 THEN 'ambiguous' WHEN s.key IS NULL THEN 'unknown' END AS error FROM q LEFT JOIN s ON s.k = q.k""")
def j11_names(spark, d):
    """Ambiguous names, nicknames and parts of names."""
    k = F.col("s_suppkey")
    text = k.cast("string")
    c = b.table(spark, d, "supplier").select(F.lpad(text, 10, "0").alias("key"), F.concat(F.lit("T"), text).alias("ticker"), F.concat(F.lit("A middle"), text, F.lit("x Z")).alias("name"), F.concat(F.lit("Twin"), (k % 5).cast("string")).alias("name_en"))
    aliases = b.table(spark, d, "supplier").select(F.concat(F.lit("Nick "), text).alias("alias"), F.concat(F.lit("T"), text).alias("ticker"))
    n = F.col("c_custkey")
    q = F.when(n % 3 == 0, F.concat(F.lit("twin"), (n % 5).cast("string"))).when(n % 3 == 1, F.concat(F.lit("nick "), (n % 50).cast("string"))).otherwise(F.concat(F.lit("middle"), (n % 50).cast("string"), F.lit("X")))
    return comp.resolve_companies(b.table(spark, d, "customer").select(q.alias("query")), c, aliases)


@query(f"""WITH {ARTICLES} SELECT strftime(coalesce(published_at, collected_at) + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(*) AS n, count(published_at) AS dated, sum(sentiment_score)::BIGINT AS score, min(title) AS first_title, count(*) AS without_symbol_url FROM articles GROUP BY 1""")
def io1_typed_tables(spark, d):
    """IO1, IO17: articles written in folders by day and read again by the stored table's types; columns that they lack are null."""
    path = folder(spark)
    tables.write_articles(b.articles(spark, d).drop("body", "source_id"), path)
    rows = tables.read(spark, "articles", path).withColumn("day", F.date_format(F.coalesce("published_at", "collected_at") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd"))
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.count("published_at").alias("dated"), F.sum("sentiment_score").alias("score"), F.min("title").alias("first_title"), F.count_if(F.col("canonical_url").isNull()).alias("without_symbol_url"))


@query("""WITH f AS (SELECT o_custkey AS cik, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderkey % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '20-F' ELSE '6-K' END AS form FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
r AS (SELECT cik, bool_or(pos < 20 AND form = '10-K') AS dom, bool_or(pos < 20 AND form = '20-F') AS ann, bool_or(n - pos <= 20 AND form = '10-K') AS odom, bool_or(n - pos <= 20 AND form = '20-F') AS oann,
  min_by(day, pos) FILTER (form IN ('10-K', '20-F')) AS annual, min_by(day, pos) AS newest FROM f GROUP BY 1),
g AS (SELECT *, CASE WHEN dom THEN '미국 내국법인 양식(10-K·10-Q)' WHEN ann THEN '미국 기준 외국법인 양식(20-F)' ELSE '미국 기준 외국법인 양식(6-K 중심)' END AS now, CASE WHEN odom THEN '미국 내국법인 양식(10-K·10-Q)' WHEN oann THEN '미국 기준 외국법인 양식(20-F)' ELSE '미국 기준 외국법인 양식(6-K 중심)' END AS old FROM r),
m AS (SELECT cik, string_agg(form || ' ' || c || '건', ', ' ORDER BY c DESC, p) AS mix FROM (SELECT cik, form, count(*) AS c, min(pos) AS p FROM f GROUP BY 1, 2) GROUP BY 1),
i AS (SELECT *, 'Filer ' || cik AS name, CASE cik % 3 WHEN 0 THEN '' WHEN 1 THEN 'DE' ELSE 'C3' END AS state FROM g),
e AS (SELECT cik, 'sec:profile' AS id, name || ' SEC 발행사 프로필' AS title, coalesce(annual, newest) AS observed_at, '2024-01-02' AS available_at, 'CIK ' || cik || '; 사명 ' || name || '; 거래소 ' || CASE WHEN cik % 2 = 0 THEN 'NYSE, Nasdaq' ELSE '미상' END || '; 업종 미상; 설립지 ' || CASE state WHEN '' THEN '미상' WHEN 'DE' THEN 'DE' ELSE 'C3(미국 밖)' END || '; 결산월 1231; 보고 양식 ' || now || '.'
    || CASE WHEN NOT dom THEN ' 이 양식은 분기 실적 공시 의무가 없어 10-Q 가 존재하지 않는다.' ELSE '' END || CASE WHEN old <> now THEN ' 과거에는 ' || old || ' 으로 보고했다. 보고 체계가 바뀐 구간은 회계기준(IFRS/US-GAAP)도 함께 바뀌었을 수 있다.' ELSE '' END || CASE WHEN state = 'C3' AND dom THEN ' 미국 밖에서 설립된 법인이지만 미국 내국법인 양식으로 보고한다.' ELSE '' END AS summary FROM i
  UNION ALL SELECT cik, 'sec:filings-mix', name || ' 최근 공시 구성', coalesce(annual, newest), '2024-01-02', '최근 공시 폼 분포: ' || mix || '.' FROM i JOIN m USING (cik)
  UNION ALL SELECT cik, 'sec:filing:A-' || k, form || ' (' || day || ' 기준)', day, day, 'Filer ' || cik || ' 가 ' || day || ' 에 제출한 ' || form || '.' FROM f WHERE pos < 5)
SELECT * FROM e""")
def x21_profile_evidence(spark, d):
    """X21, X20, IO11: orders as submission files, read into the evidence of who reports, how, and what."""
    k, cik = F.col("o_orderkey"), F.col("cik")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    f = F.struct(k, F.when(k % 3 == 0, "10-K").when(k % 3 == 1, "20-F").otherwise("6-K").alias("form"), day.alias("day"), F.concat(F.lit("A-"), k.cast("string")).alias("no"), F.lit("").alias("doc"))
    per = b.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cik")).agg(F.sort_array(F.collect_list(f)).alias("r"))
    part = lambda n: F.transform("r", lambda x: x[n])
    recent = F.struct(part("form").alias("form"), part("day").alias("filingDate"), part("doc").alias("reportDate"), part("no").alias("accessionNumber"), part("doc").alias("primaryDocument"))
    state = F.when(cik % 3 == 0, F.lit(None)).when(cik % 3 == 1, " de").otherwise("C3")
    raw = per.select("cik", F.to_json(F.struct(F.concat(F.lit("Filer "), cik.cast("string")).alias("name"), F.when(cik % 2 == 0, F.array(F.lit("NYSE"), F.lit("Nasdaq"))).alias("exchanges"), state.alias("stateOfIncorporation"), F.lit("1231").alias("fiscalYearEnd"), F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    listed = filings.submissions(raw)
    out = filings.profile_evidence(filings.filer_profiles(listed), listed, filings.filer_identities(raw), "2024-01-02")
    return out.select("cik", "id", "title", "observed_at", "available_at", "summary")


@query("""WITH x AS (SELECT c_custkey AS k, c_acctbal AS cap FROM customer),
r AS (SELECT k, CASE WHEN cap > 0 THEN cap / 200 END AS pe, CASE WHEN cap > 0 THEN cap / 1000 END AS pb FROM x)
SELECT k AS company, 'dart:accounts:' || k || ':2024:11011' AS id, 'C' || k || ' 2024 사업보고서 주요계정' AS title, '매출액=' || format('{:,}', k + 2000) || '원; ' || CASE WHEN k % 2 = 0 THEN '당기순이익=-200원; ' ELSE '' END || '자본총계=1,000원' AS summary FROM r""")
def x21_account_evidence(spark, d):
    """X21, IO12, W18: customers as statement files, read into evidence of their main accounts."""
    k = F.col("c_custkey")
    row = lambda name, div, now: F.struct(F.lit(name).alias("account_nm"), F.lit(div).alias("fs_div"), now.alias("thstrm_amount"), F.lit("-").alias("frmtrm_amount"))
    money = F.format_number((k + 2000).cast("long"), 0)
    rows = F.array(row("자본총계", "CFS", F.lit("1,000")), row("매출액", "OFS", F.lit("9")), row("매출액", "CFS", money), row("다른계정", "CFS", F.lit("5")), row("당기순이익", "OFS", F.when(k % 2 == 0, "-200").otherwise("-")))
    c = b.table(spark, d, "customer")
    raw = c.select(k.alias("company"), F.to_json(F.struct(rows.alias("list"))).alias("json"))
    names = c.select(k.alias("company"), F.concat(F.lit("C"), k.cast("string")).alias("name"))
    return filings.account_evidence(filings.dart_accounts(raw), names, "2024", "11011", "2024-01-02").select("company", "id", "title", "summary")


@query("""WITH e AS (SELECT user_id::VARCHAR AS symbol, event_id AS k, date_trunc('second', ts::TIMESTAMP) AS seen, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), v AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n) AS nth FROM e WHERE n <= 8 AND k % 5 <> 0)
SELECT symbol, 'external-news:' || CASE WHEN k % 2 = 0 THEN 'c' || k WHEN k % 3 = 0 THEN 'r' || k ELSE nth::VARCHAR END AS id, 'News ' || k AS title, CASE WHEN k % 2 = 0 THEN 'Desk ' || (k % 7) ELSE 'Yahoo Finance' END AS source,
  CASE WHEN k % 7 <> 3 THEN epoch_ms(seen) END AS observed_at, CASE WHEN k % 2 = 0 THEN 'told' ELSE 'described' END AS summary, CASE WHEN k % 2 = 0 THEN 'https://n.com/' || k ELSE 'https://l.com/' || k END AS url FROM v""")
def io13_vendor_news(spark, d):
    """IO13: events as a quote vendor's news, nested and flat, read again."""
    k = F.col("event_id")
    text = k.cast("string")
    e = b.table(spark, d, "events").withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp")))
    title = F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" News "), text))
    nested = F.to_json(F.struct(F.concat(F.lit("r"), text).alias("id"), F.struct(F.concat(F.lit("c"), text).alias("id"), title.alias("title"), F.struct(F.concat(F.lit("Desk "), (k % 7).cast("string")).alias("displayName")).alias("provider"), F.struct(F.concat(F.lit("https://n.com/"), text).alias("url")).alias("canonicalUrl"), F.when(k % 7 == 3, "soon").otherwise(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("pubDate"), F.lit("told").alias("summary")).alias("content")))
    flat = F.to_json(F.struct(F.when(k % 3 == 0, F.concat(F.lit("r"), text)).alias("id"), title.alias("title"), F.lit("a name").alias("provider"), F.concat(F.lit("https://l.com/"), text).alias("link"), F.when(k % 7 != 3, F.unix_seconds("at")).alias("providerPublishTime"), F.lit("described").alias("description")))
    rows = e.select(F.col("user_id").cast("string").alias("symbol"), k.alias("pos"), F.when(k % 2 == 0, nested).otherwise(flat).alias("json"))
    return stock_news.vendor_news(rows).withColumn("observed_at", F.unix_millis("observed_at"))


@query("""SELECT lpad(p_partkey::VARCHAR, 8, '0') AS key, lpad(p_partkey::VARCHAR, 6, '0') AS ticker, p_name AS name, upper(p_name) AS name_en, (SELECT max(strftime(DATE '2025-01-01' + (p_partkey % 300)::INT, '%Y-%m-%d')) FROM part WHERE p_partkey % 4 <> 0) AS as_of FROM part WHERE p_partkey % 4 <> 0""")
def io8_split_lists(spark, d):
    """IO8, IO9: parts as XML lists laid down as plain files, which tasks read in splits."""
    k = F.col("p_partkey")
    tag = lambda name, v: F.concat(F.lit(f"<{name}>"), v, F.lit(f"</{name}>\n"))
    day = F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (k % 300).cast("int")), "yyyyMMdd")
    code = F.when(k % 4 != 0, F.lpad(k.cast("string"), 6, "0")).otherwise(F.lit(" "))
    record = F.concat(F.lit("\n<list>\n"), tag("corp_code", F.lpad(k.cast("string"), 8, "0")), tag("corp_name", F.col("p_name")), tag("corp_eng_name", F.upper("p_name")), tag("stock_code", code), tag("modify_date", day))
    path = tables.folder(spark)
    comp.write_records(b.table(spark, d, "part").select(record.alias("record")), path, "</list>")
    return comp.corp_codes(comp.read_records(spark, path, "</list>"), least=1)
