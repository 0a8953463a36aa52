"""Filing, company, valuation and stock-news queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import companies as comp
from tidemark.operators import filings as ops
from tidemark.operators import stock_news, valuation
from tidemark.plans.registry import query, rounded
from tidemark.sources import bindings as b
from tidemark.sources.bindings import ARTICLES, BRIDGE

FACTS_SQL = """f AS (SELECT o_custkey AS cik, CASE o_orderkey % 3 WHEN 0 THEN 'revenue' WHEN 1 THEN 'income' ELSE 'equity' END AS item, year(o_orderdate)::VARCHAR AS period, o_totalprice AS val, strftime(o_orderdate, '%Y-%m-%d') AS filed, o_orderkey AS pos FROM orders),
l AS (SELECT cik, item, period, max_by(val, (filed, -pos)) AS value FROM f GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY cik, item ORDER BY period DESC) AS nth FROM l),
r AS (SELECT cik, period AS rp FROM a WHERE item = 'revenue' AND nth = 1),
o AS (SELECT cik, coalesce(max(rp), '') AS period, max(value) FILTER (item = 'revenue' AND nth = 1) AS rev, max(value) FILTER (item = 'revenue' AND nth = 2) AS prev,
  coalesce(max(value) FILTER (item = 'income' AND period = rp), max(value) FILTER (item = 'income' AND nth = 1)) AS inc, coalesce(max(value) FILTER (item = 'equity' AND period = rp), max(value) FILTER (item = 'equity' AND nth = 1)) AS eq FROM a LEFT JOIN r USING (cik) GROUP BY cik),
x AS (SELECT cik, o.period, CASE WHEN c_acctbal > 0 AND inc > 0 THEN c_acctbal / inc END AS trailing_pe, CASE WHEN c_acctbal > 0 AND eq > 0 THEN c_acctbal / eq END AS price_to_book, CASE WHEN rev <> 0 THEN inc / rev * 100 END AS profit_margin_pct, CASE WHEN prev <> 0 THEN (rev / prev - 1) * 100 END AS revenue_growth_pct FROM o LEFT JOIN customer ON c_custkey = cik)"""
RATIOS = ["trailing_pe", "price_to_book", "profit_margin_pct", "revenue_growth_pct"]


@query(f"WITH {FACTS_SQL} SELECT cik, period, {', '.join(f'round({c}, 6) AS {c}' for c in RATIOS)} FROM x WHERE coalesce({', '.join(RATIOS)}) IS NOT NULL")
def x19_sec_fundamentals(spark, d):
    """Ratios from annual facts."""
    k = F.col("o_orderkey") % 3
    o = b.table(spark, d, "orders")
    facts = o.select(F.col("o_custkey").alias("cik"), F.lit("us-gaap").alias("taxonomy"), F.when(k == 0, "Revenues").when(k == 1, "NetIncomeLoss").otherwise("StockholdersEquity").alias("concept"), F.lit("USD").alias("unit"), F.lit(0).alias("unit_pos"), F.col("o_orderkey").alias("pos"), F.lit("10-K").alias("form"), F.year("o_orderdate").cast("string").alias("end"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"), F.col("o_totalprice").alias("val"))
    caps = b.table(spark, d, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_acctbal").alias("market_cap"))
    return rounded(ops.sec_fundamentals(facts, caps).select("cik", "period", *RATIOS), RATIOS)


@query("""SELECT l_suppkey AS company, l_returnflag || (l_partkey % 3) AS account_name, l_orderkey * 10 + l_linenumber AS pos, fs AS fs_div FROM (SELECT *, CASE l_returnflag WHEN 'N' THEN 'CFS' WHEN 'A' THEN 'OFS' ELSE 'X' END AS fs FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag || (l_partkey % 3) ORDER BY CASE fs WHEN 'CFS' THEN 0 WHEN 'OFS' THEN 1 ELSE 2 END, l_orderkey * 10 + l_linenumber) = 1""")
def w18_select_accounts(spark, d):
    """One row for each account, by kind of statement."""
    f = F.col("l_returnflag")
    a = b.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("company"), F.concat(f, (F.col("l_partkey") % 3).cast("string")).alias("account_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(f == "N", "CFS").when(f == "A", "OFS").otherwise("X").alias("fs_div"))
    return ops.select_accounts(a)


@query("""WITH f AS (SELECT o_custkey AS cik, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n, CASE o_orderkey % 5 WHEN 0 THEN '10-Q' WHEN 1 THEN '20-F' WHEN 2 THEN '6-K' ELSE '8-K' END AS form FROM orders),
r AS (SELECT cik, CASE WHEN bool_or(pos < 3 AND form = '10-Q') THEN '미국 내국법인 양식(10-K·10-Q)' WHEN bool_or(pos < 3 AND form = '20-F') THEN '미국 기준 외국법인 양식(20-F)' WHEN bool_or(pos < 3 AND form = '6-K') THEN '미국 기준 외국법인 양식(6-K 중심)' ELSE '미상' END AS reporting_regime,
  CASE WHEN bool_or(n - pos <= 3 AND form = '10-Q') THEN '미국 내국법인 양식(10-K·10-Q)' WHEN bool_or(n - pos <= 3 AND form = '20-F') THEN '미국 기준 외국법인 양식(20-F)' WHEN bool_or(n - pos <= 3 AND form = '6-K') THEN '미국 기준 외국법인 양식(6-K 중심)' ELSE '미상' END AS previous_regime FROM f GROUP BY cik),
y AS (SELECT cik, min_by(form, pos) AS annual_form FROM f WHERE form = '20-F' GROUP BY cik),
c AS (SELECT cik, string_agg(form || ':' || n, ',' ORDER BY n DESC, p) AS form_counts FROM (SELECT cik, form, count(*) AS n, min(pos) AS p FROM f GROUP BY 1, 2) GROUP BY cik)
SELECT r.*, previous_regime <> '미상' AND previous_regime <> reporting_regime AS regime_changed, annual_form, form_counts FROM r LEFT JOIN y USING (cik) JOIN c USING (cik)""")
def x20_filer_profiles(spark, d):
    """Reporting regimes by forms."""
    from pyspark.sql import Window

    k = F.col("o_orderkey") % 5
    o = b.table(spark, d, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")) - 1
    f = o.select(F.col("o_custkey").alias("cik"), pos.alias("pos"), F.when(k == 0, "10-Q").when(k == 1, "20-F").when(k == 2, "6-K").otherwise("8-K").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed_at"))
    counts = F.array_join(F.transform(F.map_entries("form_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return ops.filer_profiles(f, 3).select("cik", "reporting_regime", "previous_regime", "regime_changed", "annual_form", counts.alias("form_counts"))


@query("""WITH r AS (SELECT c_custkey::VARCHAR AS symbol, DATE '1997-06-30' + (c_custkey % 400)::INT AS as_of FROM customer WHERE c_custkey % 3 = 0),
e AS (SELECT o_custkey::VARCHAR AS symbol, o_orderpriority AS kind, o_orderkey AS id, o_orderdate::DATE AS observed_at, o_orderdate::DATE + 45 AS available_at FROM orders)
SELECT as_of::VARCHAR AS as_of, symbol, kind, max_by(id, (observed_at, available_at, id)) AS id FROM r JOIN e USING (symbol) WHERE available_at <= as_of GROUP BY 1, 2, 3""")
def j12_evidence_as_of(spark, d):
    """The latest evidence that was known at the time of each run."""
    k = F.col("c_custkey")
    runs = b.table(spark, d, "customer").where(k % 3 == 0).select(k.cast("string").alias("symbol"), F.date_add(F.lit("1997-06-30").cast("date"), (k % 400).cast("int")).alias("as_of"))
    day = F.col("o_orderdate").cast("date")
    e = b.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("id"), day.alias("observed_at"), F.date_add(day, 45).alias("available_at"))
    return ops.evidence_as_of(e, runs).select(F.col("as_of").cast("string").alias("as_of"), "symbol", "kind", "id")


def companies(spark, d):
    """Suppliers as companies."""
    k = F.col("s_suppkey").cast("string")
    return b.table(spark, d, "supplier").select(F.lpad(k, 10, "0").alias("key"), F.concat(F.lit("T"), k).alias("ticker"), F.concat("s_name", F.lit(", Inc.")).alias("name"), F.col("s_acctbal").alias("market_cap"))


COMPANIES = "companies AS (SELECT lpad(s_suppkey::VARCHAR, 10, '0') AS key, 'T' || s_suppkey AS ticker, s_name || ', Inc.' AS name, s_acctbal AS market_cap, upper(regexp_replace(s_name, '[\\s.,\\-_/&''\"#]+', '', 'g')) AS n0, upper(regexp_replace(s_name, '[\\s.,\\-_/&''\"]+', '', 'g')) AS n FROM supplier)"


@query(f"""WITH {COMPANIES}, q AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN lpad((c_custkey % 150)::VARCHAR, 10, '0') WHEN 1 THEN 't' || (c_custkey % 150) || '.ks' WHEN 2 THEN (SELECT min(s_name) FROM supplier WHERE s_suppkey = c_custkey % 150) || ' Corp' ELSE 'nobody ' || c_custkey END AS query, c_custkey % 4 AS kind, c_custkey % 150 AS k FROM customer)
SELECT query, c.key, CASE WHEN c.key IS NULL THEN NULL WHEN kind = 0 THEN 'key' WHEN kind = 1 THEN 'ticker' ELSE 'name' END AS method, CASE WHEN c.key IS NULL THEN 'unknown' END AS error FROM q LEFT JOIN companies c ON kind < 3 AND c.key = lpad(k::VARCHAR, 10, '0') WHERE query IS NOT NULL""")
def j11_resolve_companies(spark, d):
    """Identifiers resolved by key, ticker or name."""
    k = F.col("c_custkey")
    s = b.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), "s_name")
    c = b.table(spark, d, "customer").select(k, (k % 150).alias("k")).join(s, "k", "left")
    q = F.when(k % 4 == 0, F.lpad(F.col("k").cast("string"), 10, "0")).when(k % 4 == 1, F.concat(F.lit("t"), F.col("k").cast("string"), F.lit(".ks"))).when(k % 4 == 2, F.concat("s_name", F.lit(" Corp"))).otherwise(F.concat(F.lit("nobody "), k.cast("string")))
    return comp.resolve_companies(c.select(q.alias("query")).where("query is not null"), companies(spark, d))


@query(f"""WITH {COMPANIES}, q AS (SELECT DISTINCT 't' || (c_custkey % 30) AS query FROM customer), h AS (SELECT query, key, CASE WHEN ticker = upper(query) THEN 0 ELSE 1 END AS priority, market_cap, name FROM companies JOIN q ON starts_with(ticker, upper(query)))
SELECT query, rank, key, priority FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY priority, market_cap DESC, length(name), key)::INT AS rank FROM h) WHERE rank <= 10""")
def k6_autocomplete(spark, d):
    """K6: completions by ticker."""
    q = b.table(spark, d, "customer").select(F.concat(F.lit("t"), (F.col("c_custkey") % 30).cast("string")).alias("query"))
    return comp.autocomplete(q, companies(spark, d))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN lpad(c_custkey::VARCHAR, 6, '0') WHEN c_custkey % 3 = 1 THEN 'AB' || c_custkey || '.KQ' ELSE 'AB' || c_custkey END AS symbol, CASE WHEN c_custkey % 3 = 0 THEN lpad(c_custkey::VARCHAR, 6, '0') ELSE 'AB' || c_custkey END AS base, CASE WHEN c_custkey % 3 = 2 THEN 'US' ELSE 'KR' END AS market, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS n FROM customer""")
def x23_route_symbol(spark, d):
    """Markets of symbols."""
    k = F.col("c_custkey")
    s = F.when(k % 3 == 0, F.lpad(k.cast("string"), 6, "0")).when(k % 3 == 1, F.concat(F.lit(" ab"), k.cast("string"), F.lit(".kq"))).otherwise(F.concat(F.lit("ab"), k.cast("string")))
    return b.table(spark, d, "customer").select(k.alias("id"), comp.route_symbol(s).alias("r"), F.size(comp.quote_candidates(s)).alias("n")).select("id", "r.symbol", "r.base", "r.market", "n")


@query("""WITH x AS (SELECT p_partkey::VARCHAR AS symbol, p_retailprice AS price, p_size - 5.0::DOUBLE AS eps, p_size * 2.0::DOUBLE AS bv, p_retailprice * 3 AS ebitda, 50.0::DOUBLE AS cash, 100.0::DOUBLE AS debt, 10.0::DOUBLE AS shares, p_size::DOUBLE AS g, p_partkey % 20 + 1.0::DOUBLE AS dr FROM part),
m AS (SELECT symbol, price, dr <= 2 AS bad, 'pe' AS method, CASE WHEN eps > 0 THEN eps * 20 END AS v FROM x UNION ALL SELECT symbol, price, dr <= 2, 'pb', bv * 3 FROM x UNION ALL SELECT symbol, price, dr <= 2, 'ev_ebitda', (ebitda * 6 + cash - debt) / shares FROM x
UNION ALL SELECT symbol, price, dr <= 2, 'dcf', (list_sum(list_transform(range(1, 6), lambda y: 100 * pow(1 + g / 100, y) / pow(1 + dr / 100, y))) + 100 * pow(1 + g / 100, 5) * 1.02 / ((dr - 2) / 100) / pow(1 + dr / 100, 5) + cash - debt) / shares FROM x)
SELECT symbol, method, CASE WHEN NOT bad AND v > 0 THEN round(v, 4) END AS value, CASE WHEN NOT bad AND v > 0 THEN round((v / price - 1) * 100, 4) END AS upside_pct, bad AS failed FROM m""")
def x18_valuation(spark, d):
    """Four ways to value a share; discount rates not above the growth are refused."""
    lit = lambda x: F.lit(float(x))
    p = b.table(spark, d, "part")
    x = p.select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_retailprice").alias("price"), (F.col("p_size") - lit(5)).alias("eps"), (F.col("p_size") * lit(2)).alias("book_value_per_share"), (F.col("p_retailprice") * 3).alias("ebitda"), lit(50).alias("cash"), lit(100).alias("debt"), lit(10).alias("shares"), F.lit("USD").alias("currency"), F.lit("USD").alias("financial_currency"))
    a = p.select(F.col("p_partkey").cast("string").alias("symbol"), lit(20).alias("target_pe"), lit(3).alias("target_pb"), lit(6).alias("target_ev_ebitda"), lit(100).alias("fcff"), F.col("p_size").cast("double").alias("growth_pct"), (F.col("p_partkey") % 20 + lit(1)).alias("discount_pct"), lit(2).alias("terminal_growth_pct"))
    out = valuation.valuation(valuation.valuation_inputs(x), a)
    return rounded(out.select("symbol", "method", "value", "upside_pct", F.col("error").isNotNull().alias("failed")), ["value", "upside_pct"], 4)


@query(f"""WITH {ARTICLES}, {BRIDGE}, q AS (SELECT DISTINCT symbol FROM bridge), r AS (SELECT DISTINCT symbol, article_id FROM bridge), n AS (SELECT r.symbol, article_id, row_number() OVER (PARTITION BY r.symbol ORDER BY published_at DESC, article_id DESC)::INT AS n
FROM r JOIN q USING (symbol) JOIN articles a USING (article_id) WHERE published_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-20') SELECT symbol || '.KS' AS symbol, article_id, n FROM n WHERE n <= 50""")
def j8_stored_news(spark, d):
    """Stored news of each symbol asked for."""
    br = b.bridge(spark, d).select("article_id", "symbol")
    q = br.select(F.concat("symbol", F.lit(".KS")).alias("symbol")).distinct().withColumns({"since": F.lit(datetime(2024, 1, 1)).cast("timestamp"), "until": F.lit(datetime(2024, 1, 20)).cast("timestamp")})
    return stock_news.stored_news(b.articles(spark, d).drop("symbol"), br, b.insights(spark, d), q).select("symbol", "article_id", "n")


@query("""WITH c AS (SELECT user_id::VARCHAR AS provider, ts::TIMESTAMP AS ts, event_id, CASE event_type WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 503 ELSE 400 END ELSE 200 END AS status FROM events),
k AS (SELECT *, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, CASE status WHEN 200 THEN '정상' WHEN 429 THEN 'quota' WHEN 401 THEN 'auth' WHEN 503 THEN 'transient' ELSE 'request' END AS state FROM c),
u AS (SELECT *, date_trunc('day', ts + INTERVAL 9 HOUR) + INTERVAL 15 HOUR AS midnight FROM k),
z AS (SELECT *, CASE state WHEN 'quota' THEN CASE WHEN event_id % 8 = 0 THEN ts + INTERVAL 27 SECOND ELSE least(midnight, ts + INTERVAL 1 HOUR) END WHEN 'auth' THEN ts + INTERVAL 6 HOUR WHEN 'request' THEN ts + INTERVAL 30 MINUTE WHEN 'transient' THEN ts + INTERVAL 5 MINUTE END AS until FROM u),
l AS (SELECT provider, max(struct_pack(ts := ts, state := state, until := until)) AS l FROM z GROUP BY 1)
SELECT p.provider, max(day)::VARCHAR AS usage_date_kst, max_by(used, day) AS used_today, sum(good)::BIGINT AS success_count, sum(used - good)::BIGINT AS failure_count, any_value(l.state) AS last_status, floor(epoch(any_value(l.until)))::BIGINT AS cooldown_until FROM (SELECT provider, day, count(*) AS used, count(*) FILTER (status = 200) AS good FROM k GROUP BY 1, 2) p JOIN l ON p.provider = l.provider GROUP BY 1""")
def a12_provider_ledger(spark, d):
    """The ledger of calls by provider."""
    e = F.col("event_id") % 4
    status = F.when(F.col("event_type") != "error", 200).when(e == 0, 429).when(e == 1, 401).when(e == 2, 503).otherwise(400)
    calls = b.table(spark, d, "events").select(F.col("user_id").cast("string").alias("provider"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), F.when(F.col("event_id") % 8 == 0, '429 {"retryDelay": "27s"}').otherwise("").alias("detail"))
    return stock_news.provider_ledger(calls).select("provider", F.col("usage_date_kst").cast("string").alias("usage_date_kst"), "used_today", "success_count", "failure_count", "last_status", F.unix_seconds("cooldown_until").alias("cooldown_until"))


def stock_items(spark, d):
    """Events as news items of stocks, and what is asked for."""
    e = F.col("event_id")
    items = b.table(spark, d, "events").select(F.concat(F.lit("ARM"), (F.col("user_id") % 20).cast("string")).alias("symbol"), F.when(e % 3 == 0, "DB").when(e % 3 == 1, "Naver").otherwise("GDELT").alias("provider"), e.alias("seq"), F.concat(F.lit("news of ARM"), (F.col("user_id") % 20).cast("string")).alias("title"), F.lit("").alias("summary"), F.concat(F.lit("https://x.com/"), (e % 500).cast("string"), F.lit("?utm_source="), F.col("event_type")).alias("url"), F.col("ts").cast("timestamp").alias("observed_at"), F.when(e % 2 == 0, F.col("value")).alias("score"))
    q = items.select("symbol").distinct().withColumns({"terms": F.array("symbol"), "since": F.lit(datetime(2023, 1, 1)).cast("timestamp"), "until": F.lit(datetime(2025, 1, 1)).cast("timestamp")})
    return items, q


@query("""WITH i AS (SELECT event_id AS seq, 'ARM' || (user_id % 20) AS symbol, CASE event_id % 3 WHEN 0 THEN 'DB' WHEN 1 THEN 'Naver' ELSE 'GDELT' END AS provider, event_id % 500 AS u, ts::TIMESTAMP AS ts, CASE WHEN event_id % 2 = 0 THEN value END AS score FROM events),
f AS (SELECT *, first_value(provider) OVER w AS fp, bool_or(provider = 'DB' AND score IS NOT NULL) OVER (PARTITION BY symbol, u) AS has FROM i WINDOW w AS (PARTITION BY symbol, u ORDER BY seq)),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol, u ORDER BY CASE WHEN fp <> 'DB' AND has THEN CASE WHEN provider = 'DB' AND score IS NOT NULL THEN 0 ELSE 1 END ELSE 0 END, seq) = 1),
r AS (SELECT *, 'stock-news:' || substr(sha256('https://x.com/' || u), 1, 32) AS id, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, 'stock-news:' || substr(sha256('https://x.com/' || u), 1, 32))::INT AS rank FROM k) SELECT symbol, rank, id, provider FROM r WHERE rank <= 12""")
def w16_select_stock_news(spark, d):
    """News chosen for each stock."""
    return stock_news.select_stock_news(*stock_items(spark, d))[0].select("symbol", "rank", "id", "provider")


TERMS = {"src1": ["of the", "thing", "ION"], "src2": ["and the", "THE."], "src3": ["ción", "de la"], "src4": ["für", "die", "la"], "src5": ["is", "src"]}
TERMS_SQL = ", ".join(f"('{s}', '{t}')" for s, ts in TERMS.items() for t in ts)


@query(rf"""WITH {ARTICLES}, t AS (SELECT * FROM (VALUES {TERMS_SQL}) AS v(source_id, term)),
h AS (SELECT article_id, title, title || ' ' || body AS whole, term, regexp_matches(term, '^[\x20-\x7E]+$') AS latin, '(^|[^a-z0-9])' || regexp_escape(lower(term)) || '([^a-z0-9]|$)' AS p FROM articles JOIN t USING (source_id))
SELECT article_id, max(CASE WHEN NOT CASE WHEN latin THEN regexp_matches(lower(whole), p) ELSE contains(whole, term) END THEN 0 WHEN CASE WHEN latin THEN regexp_matches(lower(title), p) ELSE contains(title, term) END THEN 2 ELSE 1 END)::INT AS relevance FROM h GROUP BY 1""")
def t11_relevance(spark, d):
    """How relevant documents are to their sources' words and phrases."""
    q = spark.createDataFrame(list(TERMS.items()), "symbol string, terms array<string>")
    items = b.articles(spark, d).select("article_id", F.col("source_id").alias("symbol"), "title", F.col("body").alias("summary"))
    return stock_news.news_relevance(items, q).select("article_id", "relevance")


@query("""WITH q AS (SELECT c_custkey AS id, 'T' || (c_custkey % 60) AS symbol, trim(c_name) AS company FROM customer),
e AS (SELECT 'T' || n_nationkey AS symbol, [n_name, 'T' || n_nationkey || ' Corp'] AS aliases FROM nation), c AS (SELECT 'T' || s_suppkey AS symbol, [s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'T' || s_suppkey END, s_name] AS names FROM supplier),
l AS (SELECT id, q.symbol, e.symbol AS entry_symbol, list_concat([company], coalesce(names, []), coalesce(e.aliases, []), [q.symbol]) AS t FROM q LEFT JOIN e USING (symbol) LEFT JOIN c USING (symbol))
SELECT symbol, entry_symbol, array_to_string(list_filter(t, lambda x, i: x IS NOT NULL AND list_position(t, x) = i), '|') AS terms FROM l""")
def t11_stock_queries(spark, d):
    """What news may call a stock, by its company and the dictionary's entry."""
    k = F.col("c_custkey")
    requests = b.table(spark, d, "customer").select(F.concat(F.lit("t"), (k % 60).cast("string"), F.when(k % 2 == 0, ".KS").otherwise("")).alias("symbol"), F.col("c_name").alias("company"), F.lit(datetime(2024, 1, 30)).cast("timestamp").alias("now"))
    n = F.concat(F.lit("T"), F.col("n_nationkey").cast("string"))
    entries = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), n.alias("symbol"), F.lower(n).alias("name"), F.array("n_name", F.concat(n, F.lit(" Corp"))).alias("aliases"))
    base = F.concat(F.lit("T"), F.col("s_suppkey").cast("string"))
    known = b.table(spark, d, "supplier").select(base.alias("base"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, base).alias("name_en"), F.array("s_name").alias("aliases"))
    out = stock_news.stock_queries(requests, known, entries)
    return out.select("symbol", "entry_symbol", F.array_join("terms", "|").alias("terms"))
