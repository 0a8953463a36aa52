"""Scoring and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import indicators, market
from tidemark.operators import ranking as ops
from tidemark.plans.markets import SNAPSHOT_SQL
from tidemark.plans.registry import query, rounded
from tidemark.sources import bindings as b
from tidemark.sources.bindings import MENTIONS


def curve_sql(c: str, points: list) -> str:
    """A curve in SQL."""
    out = f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= {points[0][0]} THEN {points[0][1]}::DOUBLE"
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out += f" WHEN {c} <= {x1} THEN {y0} + ({c} - {x0}) / ({x1} - {x0})::DOUBLE * ({y1} - {y0})"
    return out + f" ELSE {points[-1][1]}::DOUBLE END"


def factor_sql(curves: dict) -> str:
    """A factor in SQL."""
    parts = [curve_sql(c, p) for c, p in curves.items()]
    return f"coalesce(list_avg([{', '.join(parts)}]), 50)"


FUNDAMENTALS_SQL = """facts AS (SELECT (o_custkey % 100 + 1)::VARCHAR AS symbol, sum(o_totalprice) AS t, count(*) AS n FROM orders GROUP BY 1),
fundamentals AS (SELECT symbol, 5 + t % 50 AS trailing_pe, 0.5 + n % 9 AS price_to_book, t % 40 - 10 AS profit_margin_pct, n % 60 - 20 AS revenue_growth_pct FROM facts)"""
NEWS_SQL = f"""{MENTIONS}, latest AS (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC NULLS FIRST, article_id DESC) <= 20),
news AS (SELECT symbol, coalesce(avg(score), 50) AS news, count(score) AS news_observations FROM latest GROUP BY symbol)"""
SCORES_SQL = f"""{SNAPSHOT_SQL}, {NEWS_SQL}, {FUNDAMENTALS_SQL},
scores AS (SELECT s.symbol, price, coalesce(atr_20, 0) AS atr_20, {factor_sql(ops.QUALITY).replace("gross_margin_pct", "NULL::DOUBLE")} AS quality, {factor_sql(ops.VALUE)} AS value, {factor_sql(ops.MOMENTUM)} AS momentum,
  50.0::DOUBLE AS revisions, coalesce(n.news, 50) AS news, coalesce({curve_sql("(avg_volume_20d * price)", ops.LIQUIDITY["USD"])}, 50) AS liquidity, coalesce(abs(max_drawdown_1y_pct), 0) AS drawdown, 1.0::DOUBLE AS beta,
  1 - ({" + ".join(f"({c} IS NOT NULL)::INT" for c in ops.CORE)}) / 7.0::DOUBLE AS stale_ratio, coalesce(news_observations, 0) AS news_observations
  FROM snapshot s LEFT JOIN fundamentals f USING (symbol) LEFT JOIN news n USING (symbol))"""
SCORE_NUMBERS = ["price", "atr_20", "quality", "value", "momentum", "revisions", "news", "liquidity", "drawdown", "beta", "stale_ratio"]


def news(spark, d):
    """The news factor of events."""
    m = b.mentions(spark, d)
    return ops.news_factor(m.select("symbol", "article_id"), m.select("article_id", "published_at"), m.select("article_id", F.col("score").alias("sentiment_score")))


def fundamentals(spark, d):
    """Ratios from orders, spread over symbols."""
    f = b.table(spark, d, "orders").groupBy((F.col("o_custkey") % 100 + 1).cast("string").alias("symbol")).agg(F.sum("o_totalprice").alias("t"), F.count("*").alias("n"))
    return f.select("symbol", (5 + F.col("t") % 50).alias("trailing_pe"), (0.5 + F.col("n") % 9).alias("price_to_book"), (F.col("t") % 40 - 10).alias("profit_margin_pct"), (F.col("n") % 60 - 20).alias("revenue_growth_pct"))


def scores(spark, d, as_of: str = "2001-12-31"):
    """Scores of all symbols."""
    return ops.score_snapshot(market.market_snapshot(b.bars(spark, d)).withColumn("as_of", F.lit(as_of)), news(spark, d), fundamentals(spark, d))


@query(f"WITH {NEWS_SQL} SELECT symbol, round(news, 6) AS news, news_observations FROM news")
def a8_news_factor(spark, d):
    """Mean sentiment of the latest 20 articles."""
    return rounded(news(spark, d), ["news"])


@query(f"WITH {SCORES_SQL} SELECT symbol, {', '.join(f'round({c}, 4) AS {c}' for c in SCORE_NUMBERS)}, news_observations FROM scores")
def x11_scores(spark, d):
    """Factor scores."""
    return rounded(scores(spark, d).select("symbol", *SCORE_NUMBERS, "news_observations"), SCORE_NUMBERS, 4)


REGIME = {"vix": 18.5, "usdkrw_change_20d": 1.2, "us10y_change_bp_20d": 3.0, "credit_spread_change_bp_20d": 2.0}
Z = "quality value momentum revisions news".split()
RANK_SQL = f"""{SCORES_SQL}, e AS (SELECT * FROM scores WHERE price > 0 AND liquidity >= 35 AND stale_ratio <= 0.15),
o AS (SELECT count(*) AS n, avg((news_observations > 0)::INT) >= 0.6 AS news_on, {', '.join(f'list(e.{c} ORDER BY e.{c}) AS l_{c}' for c in Z)} FROM e),
c AS (SELECT e.*, news_on, {', '.join(f'least(l_{c}[least(n - 1, floor(n * 0.95)::INT) + 1], greatest(l_{c}[greatest(0, floor(n * 0.05)::INT - 1) + 1], e.{c})) AS c_{c}' for c in Z)} FROM e, o),
z AS (SELECT *, {', '.join(f'50 + 18 * CASE WHEN stddev_pop(c_{c}) OVER () > 0 THEN (c_{c} - avg(c_{c}) OVER ()) / stddev_pop(c_{c}) OVER () ELSE 0 END AS n_{c}' for c in Z)},
  greatest(0, least(1, 1 / (1 + exp(-((18.5 - 18) / 8.0::DOUBLE + 1.2 / 6.0::DOUBLE + 2.0 / 40.0::DOUBLE))) - 0.35)) AS ro FROM c),
w AS (SELECT *, CASE WHEN news_on THEN 0.1 ELSE 0 END AS wn, greatest(0, 100 - drawdown * 1.8 - beta * 12 - ro * 18) AS risk FROM z),
s AS (SELECT *, greatest(0, least(100, (n_quality * (0.22 + 0.07 * ro) + n_value * (0.17 + 0.03 * ro) + n_momentum * (0.21 - 0.05 * ro) + n_revisions * 0.2 + n_news * wn + risk * 0.1) / (0.22 + 0.07 * ro + 0.17 + 0.03 * ro + 0.21 - 0.05 * ro + 0.2 + wn + 0.1))) AS score,
  price - atr_20 * greatest(0.8, 1.8 - ro * 0.6) AS stop FROM w WHERE price > 0 AND atr_20 > 0),
t AS (SELECT *, price + (price - stop) * greatest(1.6, 2.2 - ro * 0.4) AS target, row_number() OVER (ORDER BY round(score, 1) DESC, symbol)::INT AS rank FROM s)"""


def ranked(spark, d, limit=5):
    """The ranking under a given regime."""
    regime = spark.createDataFrame([tuple(REGIME.values())], ", ".join(f"{k} double" for k in REGIME))
    return ops.rank(scores(spark, d), regime, limit)


@query(f"""WITH {RANK_SQL} SELECT '2001-12-31' AS as_of, rank, symbol, round(score, 4) AS score, round(least(92, score * 0.72 + (1 - stale_ratio) * 16 + CASE WHEN news_observations > 0 THEN 4 ELSE 0 END), 4) AS confidence,
  CASE WHEN score >= 72 AND target / price - 1 >= 0.08 THEN '매수 유효' ELSE '관찰' END AS action, round(price - atr_20 * 0.55, 4) AS entry_low, round(price - atr_20 * 0.15, 4) AS entry_high, round(stop, 4) AS stop, round(target, 4) AS target,
  array_to_string(list_transform(list_sort([{', '.join(f"struct_pack(v := -n_{c}, i := {i}, name := '{c}')" for i, c in enumerate(Z[:4]))}, CASE WHEN news_on THEN struct_pack(v := -n_news, i := 4, name := 'news') ELSE struct_pack(v := 1e9::DOUBLE, i := 5, name := '') END])[1:2], lambda x: x.name), ',') AS reasons
FROM t WHERE rank <= 20""")
def x15_rank(spark, d):
    """The cross-sectional ranking."""
    out = rounded(ranked(spark, d, 20), ["score", "confidence", "entry_low", "entry_high", "stop", "target"], 4)
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {RANK_SQL} SELECT symbol, CASE WHEN price <= 0 THEN 'price' WHEN liquidity < 35 THEN 'liquidity' WHEN stale_ratio > 0.15 THEN 'stale' ELSE 'other' END AS reason FROM scores WHERE symbol NOT IN (SELECT symbol FROM t WHERE rank <= 3)""")
def f10_rejections(spark, d):
    """Why symbols aren't among the best."""
    out = ops.rejections(scores(spark, d), ranked(spark, d, 3))
    r = F.col("reason")
    return out.withColumn("reason", F.when(r.startswith("가격"), "price").when(r.startswith("거래대금"), "liquidity").when(r.startswith("시세"), "stale").otherwise("other"))


@query("""WITH s AS (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'vix' WHEN 1 THEN 'usdkrw' ELSE 'us10y' END AS name, l_shipdate::DATE AS date, max(l_extendedprice / l_quantity / 100) AS close FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY date DESC) AS n FROM s),
r AS (SELECT max(close) FILTER (name = 'vix' AND n = 1) AS vix, max(close) FILTER (name = 'usdkrw' AND n = 1) AS k1, max(close) FILTER (name = 'usdkrw' AND n = 21) AS k21, max(close) FILTER (name = 'us10y' AND n = 1) AS t1, max(close) FILTER (name = 'us10y' AND n = 21) AS t21 FROM n)
SELECT round(vix, 6) AS vix, round((k1 / k21 - 1) * 100, 6) AS usdkrw_change_20d, round((t1 - t21) * 100, 6) AS us10y_change_bp_20d, 0.0::DOUBLE AS credit_spread_change_bp_20d, true AS has_vix, true AS has_usdkrw, true AS has_us10y FROM r""")
def x13_macro_regime(spark, d):
    """The regime from index series."""
    line = b.table(spark, d, "lineitem")
    k = F.col("l_suppkey") % 3
    series = line.groupBy(F.when(k == 0, "vix").when(k == 1, "usdkrw").otherwise("us10y").alias("name"), F.col("l_shipdate").cast("date").alias("date")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("close"))
    return rounded(ops.macro_regime(series), ["vix", "usdkrw_change_20d", "us10y_change_bp_20d"])


def panel(spark, d):
    """The indicator panel of all symbols."""
    bars = b.bars(spark, d)
    snapshot = market.market_snapshot(bars).join(market.technical_metrics(bars), "symbol", "left").withColumn("currency", F.lit("USD"))
    return indicators.indicator_panel(snapshot, fundamentals(spark, d))


@query(f"""WITH {SNAPSHOT_SQL}, {FUNDAMENTALS_SQL}, m AS (
  SELECT symbol, unnest(['ma_20', 'ma_60', 'ma_100', 'atr_20', 'volatility', 'drawdown', 'trailing_pe', 'price_to_book', 'profit_margin_pct', 'revenue_growth_pct', 'beta']) AS key,
    unnest([ma_20, ma_60, ma_100, atr_20, volatility_20d_pct, max_drawdown_1y_pct, CASE WHEN trailing_pe > 0 THEN trailing_pe END, CASE WHEN price_to_book > 0 THEN price_to_book END, profit_margin_pct, revenue_growth_pct, NULL]) AS value FROM snapshot LEFT JOIN fundamentals USING (symbol))
SELECT symbol, key, round(value, 4) AS value, value IS NULL AS missing FROM m""")
def x16_indicator_panel(spark, d):
    """Indicators in long form."""
    keys = ["ma_20", "ma_60", "ma_100", "atr_20", "volatility", "drawdown", "trailing_pe", "price_to_book", "profit_margin_pct", "revenue_growth_pct", "beta"]
    return rounded(panel(spark, d).where(F.col("key").isin(keys)).select("symbol", "key", "value", "missing"), ["value"], 4)


@query()
def io17_panel_json(spark, d):
    """IO17, X27: compact panels as JSON."""
    return indicators.to_panel_json(indicators.compact_panel(panel(spark, d)), "symbol")


TREND = [k for k, *_ in indicators.PANEL["추세·모멘텀·위험"] if k not in ("volatility", "drawdown", "beta")]
STATEMENT = "CASE WHEN k % 4 < 2 THEN 'USD' WHEN k % 4 = 2 THEN 'EUR' ELSE '통화 미제공' END"
RATIO_SOURCE, RATIO_PERIOD = indicators.QUOTE_RATIO, indicators.PERIODS["ratio"]
R = indicators.REASONS
LONG_SQL = {  # value, unit, source, period, reason if it is missing
    "trailing_pe": ("CASE WHEN k % 3 = 0 AND k % 5 <> 0 THEN k % 30 + 1 WHEN k % 7 > 1 THEN k % 7 - 1 END", "'배'", "CASE WHEN k % 3 = 0 AND k % 5 <> 0 THEN 'Filings' ELSE '" + RATIO_SOURCE + "' END", "CASE WHEN k % 3 = 0 AND k % 5 <> 0 THEN '2023-12-31' ELSE '" + RATIO_PERIOD + "' END",
        f"CASE WHEN k % 3 = 0 THEN CASE WHEN k % 6 = 0 THEN '{R['filed_cap']}' WHEN k % 11 < 3 THEN '{R['filed_loss']}' ELSE 'Filings{R['filed_none']}' END WHEN k % 9 <= 2 THEN '{R['loss']}' WHEN k % 6 = 0 THEN '{R['cap']}' ELSE '{R['none']}' END"),
    "forward_pe": ("NULL", "'배'", f"'{RATIO_SOURCE}'", f"'{RATIO_PERIOD}'", f"'{R['forward_pe']}'"),
    "price_to_book": ("CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 2.5 WHEN k % 8 > 3 THEN k % 8 - 3 END WHEN k % 8 > 3 THEN k % 8 - 3 END", "'배'", f"CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'Filings' ELSE '{RATIO_SOURCE}' END", f"CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN '2023-12-31' ELSE '{RATIO_PERIOD}' END", f"'{R['price_to_book']}'"),
    "ev_ebitda": ("k % 12 + 0.5", "'배'", f"'{RATIO_SOURCE}'", f"'{RATIO_PERIOD}'", "''"),
    "eps": ("k % 9 - 2", STATEMENT, "'Yahoo Finance'", "'TTM · 종료일 미제공'", "''"),
    "bps": ("k % 13", STATEMENT, "'Yahoo Finance'", "'공급자 기준 · 결산일 미제공'", "''"),
    "roe": ("k % 21", "'%'", f"'{RATIO_SOURCE}'", f"'{RATIO_PERIOD}'", "''"),
    "roa": ("NULL", "'%'", f"'{RATIO_SOURCE}'", f"'{RATIO_PERIOD}'", f"'{R['ratio']}'"),
    "operating_margin": ("NULL", "'%'", f"'{RATIO_SOURCE}'", f"'{RATIO_PERIOD}'", f"'{R['ratio']}'"),
    "profit_margin_pct": ("CASE WHEN k % 3 = 0 THEN k % 17 END", "'%'", f"CASE WHEN k % 3 = 0 THEN 'Filings' ELSE '{RATIO_SOURCE}' END", f"CASE WHEN k % 3 = 0 THEN '2023-12-31' ELSE '{RATIO_PERIOD}' END", f"'{R['ratio']}'"),
    "revenue_growth_pct": ("NULL", "'%'", f"'{RATIO_SOURCE}'", f"'{RATIO_PERIOD}'", f"'{R['ratio']}'"),
    "fcf": ("CASE WHEN k % 10 <> 4 THEN k * 3 - k % 50 END", STATEMENT, "'Yahoo Finance'", "'2022-12-31'", f"'{R['any']}'"),
    "fcf_yield": ("CASE WHEN k % 10 <> 4 AND k % 4 < 2 AND k % 6 > 0 THEN (k * 3 - k % 50) / (k % 6 * 1000.0::DOUBLE) * 100 END", "'%'", "'Yahoo Finance'", "'재무 2022-12-31 / 시가총액 조회 시점'", f"'{R['fcf_yield']}'"),
    "net_debt": ("k % 40 - k % 25", STATEMENT, "'Yahoo Finance'", "'결산일 미제공'", "''"),
    "debt_equity": ("CASE WHEN k % 5 > 1 THEN k % 40 / (k % 5 - 1)::DOUBLE * 100 END", "'%'", "'Yahoo Finance'", "'결산일 미제공'", f"'{R['any']}'"),
    "current_ratio": ("CASE WHEN k % 4 > 0 THEN k % 30 / (k % 4)::DOUBLE * 100 END", "'%'", "'Yahoo Finance'", "'2022-09-30'", f"'{R['any']}'"),
    **{c: (f"CASE WHEN k % {i + 3} > 0 THEN k % {i + 3} + {i} END", "''" if c == "rsi_14" else "'배'" if c == "volume_ratio" else "'USD'", "'Yahoo Finance'", "'2024-01-02'", f"'{R['any']}'") for i, c in enumerate(TREND)},
    "volatility": ("k % 33", "'%'", "'Yahoo Finance'", "'2024-01-02'", "''"), "drawdown": ("NULL", "'%'", "'Yahoo Finance'", "'2024-01-02'", f"'{R['any']}'"), "beta": ("k % 3", "''", "'Yahoo Finance'", "'공급자 기준 · 추정 기간 미제공'", "''"),
}
LONG_ROWS = " UNION ALL ".join(f"SELECT k, '{key}' AS key, ({v})::DOUBLE AS value, {u} AS unit, {so} AS source, {pe} AS period, CASE WHEN ({v}) IS NULL THEN {re} ELSE '' END AS reason FROM x" for key, (v, u, so, pe, re) in LONG_SQL.items())


@query(f"WITH x AS (SELECT c_custkey AS k FROM customer), l AS ({LONG_ROWS}) SELECT k::VARCHAR AS symbol, key, round(value, 6) AS value, unit, source, period, reason FROM l")
def x16_panel_details(spark, d):
    """All indicators with unit, source, period and the reason why they are missing, over customers as symbols."""
    k = F.col("c_custkey")
    over = lambda m, least=0: F.when(k % m > least, (k % m - least).cast("double"))
    columns = {
        "observed_at": F.lit("2024-01-02"), "currency": F.lit("USD"), "financial_currency": F.when(k % 4 < 2, "USD").when(k % 4 == 2, "EUR"), "market_cap": k % 6 * 1000.0, "net_income": k % 11 - 2, "trailing_pe": k % 7 - 1, "price_to_book": k % 8 - 3, "ev_ebitda": k % 12 + 0.5,
        "eps": k % 9 - 2, "bps": k % 13, "roe": k % 21, "ocf": k * 3, "capex": -(k % 50), "ocf_period": F.lit("2022-12-31"), "capex_period": F.when(k % 10 == 4, "2021-12-31").otherwise("2022-12-31"), "cash": k % 25, "debt": k % 40, "equity": k % 5 - 1,
        "current_assets": k % 30, "current_liabilities": over(4), "current_assets_period": F.lit("2022-09-30"), **{c: over(i + 3) + i for i, c in enumerate(TREND)}, "volatility_20d_pct": k % 33, "beta": k % 3,
    }
    snapshot = b.table(spark, d, "customer").select(k.cast("string").alias("symbol"), *[c.alias(name) for name, c in columns.items()])
    filed = b.table(spark, d, "customer").where(k % 3 == 0).select(k.cast("string").alias("symbol"), F.lit("Filings").alias("source"), F.lit("2023-12-31").alias("period"), F.when(k % 5 != 0, k % 30 + 1.0).alias("trailing_pe"), F.when(k % 2 == 0, 2.5).alias("price_to_book"), (k % 17).cast("double").alias("profit_margin_pct"), F.lit(None).cast("double").alias("revenue_growth_pct"))
    out = indicators.indicator_panel(snapshot, filed)
    return rounded(out.select("symbol", "key", "value", "unit", "source", "period", "reason"), ["value"])
