"""Price bar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import market as ops
from tidemark.plans.registry import query, rounded
from tidemark.sources import bindings as b
from tidemark.sources.bindings import BARS, BARS_SQL, YEAR_SQL

SNAPSHOT_SQL = f"""{BARS_SQL},
pos AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY symbol) AS n, lag(close) OVER w AS prev,
    max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
p AS (SELECT *, n - pos AS back, close / prev - 1 AS ret, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM pos),
g AS (SELECT symbol, max(date) AS observed_at, max(n) AS bars, max(close) FILTER (back = 0) AS price, max(close) FILTER (back = 1) AS c1, max(close) FILTER (back = 21) AS c21,
    max(close) FILTER (back = 126) AS c126, min_by(close, date) AS c0, max(high) AS high_52w, stddev_samp(ret) FILTER (back < 20) AS sd, avg(tr) FILTER (back < 20) AS atr_20,
    min(close / peak - 1) * 100 AS max_drawdown_1y_pct, avg(volume) FILTER (back < 20) AS avg_volume_20d,
    CASE WHEN max(n) >= 20 THEN avg(close) FILTER (back < 20) END AS ma_20, CASE WHEN max(n) >= 60 THEN avg(close) FILTER (back < 60) END AS ma_60, CASE WHEN max(n) >= 100 THEN avg(close) FILTER (back < 100) END AS ma_100 FROM p GROUP BY symbol),
snapshot AS (SELECT symbol, observed_at, bars, price, high_52w, atr_20, max_drawdown_1y_pct, avg_volume_20d, ma_20, ma_60, ma_100,
    (price / c1 - 1) * 100 AS return_1d_pct, (price / c21 - 1) * 100 AS return_1m_pct, (price / c126 - 1) * 100 AS return_6m_pct, CASE WHEN bars >= 2 THEN (price / c0 - 1) * 100 END AS return_1y_pct,
    sd * sqrt(252) * 100 AS volatility_20d_pct, (price / high_52w - 1) * 100 AS distance_from_high_pct,
    CASE WHEN ma_100 IS NULL THEN '이평 데이터 부족' WHEN ma_20 > ma_60 AND ma_60 > ma_100 THEN '정배열' WHEN ma_20 < ma_60 AND ma_60 < ma_100 THEN '역배열' ELSE '혼조' END AS alignment,
    price > ma_20 AS price_above_ma_20, price > ma_60 AS price_above_ma_60, price > ma_100 AS price_above_ma_100 FROM g)"""

NUMBERS = ["price", "high_52w", "atr_20", "max_drawdown_1y_pct", "avg_volume_20d", "ma_20", "ma_60", "ma_100", "return_1d_pct", "return_1m_pct", "return_6m_pct", "return_1y_pct", "volatility_20d_pct", "distance_from_high_pct"]
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in NUMBERS)


@query(f"WITH {SNAPSHOT_SQL.replace(BARS_SQL, YEAR_SQL)} SELECT symbol, observed_at::VARCHAR AS observed_at, bars, {ROUNDED}, alignment, price_above_ma_20, price_above_ma_60, price_above_ma_100 FROM snapshot")
def a9_market_snapshot(spark, d):
    """The latest state of each symbol, by a year's bars."""
    return rounded(ops.market_snapshot(b.bars(spark, d, BARS)), NUMBERS).withColumn("observed_at", F.col("observed_at").cast("string"))


@query(f"""WITH {BARS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos, count(*) OVER (PARTITION BY symbol) AS n,
  avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS a20, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING) AS a60, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 99 PRECEDING) AS a100 FROM bars)
SELECT symbol, date::VARCHAR AS date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CASE WHEN pos >= 20 THEN round(a20, 6) END AS ma_20, CASE WHEN pos >= 60 THEN round(a60, 6) END AS ma_60, CASE WHEN pos >= 100 THEN round(a100, 6) END AS ma_100
FROM p WHERE n - pos < 120""")
def w4_chart_points(spark, d):
    """The last 120 bars with averages over the whole history."""
    out = ops.chart_points(b.bars(spark, d)).withColumn("date", F.col("date").cast("string"))
    return rounded(out, ["open", "high", "low", "close", "ma_20", "ma_60", "ma_100"])


@query(f"""WITH {BARS_SQL}, l AS (SELECT symbol, list(close ORDER BY date) AS p, list(volume ORDER BY date) AS v FROM bars GROUP BY symbol),
c AS (SELECT *, list_transform(range(2, len(p) + 1), lambda i: p[i] - p[i - 1]) AS ch FROM l),
r AS (SELECT *, CASE WHEN len(p) >= 15 THEN list_reduce(list_concat([list_sum(list_transform(ch[1:14], lambda x: greatest(x, 0) / 14))], list_transform(ch[15:], lambda x: greatest(x, 0))), lambda a, x: a * 13 / 14 + x / 14) END AS gain,
  CASE WHEN len(p) >= 15 THEN list_reduce(list_concat([list_sum(list_transform(ch[1:14], lambda x: greatest(-x, 0) / 14))], list_transform(ch[15:], lambda x: greatest(-x, 0))), lambda a, x: a * 13 / 14 + x / 14) END AS loss,
  CASE WHEN len(p) >= 26 THEN list_transform(range(26, len(p) + 1), lambda n: list_reduce(list_concat([list_avg(p[1:12])], p[13:n]), lambda a, x: 2.0 / 13 * x + (1 - 2.0 / 13) * a) - list_reduce(list_concat([list_avg(p[1:26])], p[27:n]), lambda a, x: 2.0 / 27 * x + (1 - 2.0 / 27) * a)) END AS m FROM c),
s AS (SELECT *, m[-1] AS macd, CASE WHEN len(m) >= 9 THEN list_reduce(list_concat([list_avg(m[1:9])], m[10:]), lambda a, x: 0.2 * x + 0.8 * a) END AS sig FROM r)
SELECT symbol, round(CASE WHEN gain + loss = 0 THEN 50 ELSE 100 * gain / (gain + loss) END, 6) AS rsi_14, round(macd, 6) AS macd, round(sig, 6) AS macd_signal, round(macd - sig, 6) AS macd_histogram,
  CASE WHEN len(p) >= 20 THEN round(list_avg(p[-20:]), 6) END AS bollinger_middle, CASE WHEN len(p) >= 20 THEN round(list_avg(p[-20:]) + 2 * list_stddev_pop(p[-20:]), 6) END AS bollinger_upper,
  CASE WHEN len(p) >= 20 THEN round(list_avg(p[-20:]) - 2 * list_stddev_pop(p[-20:]), 6) END AS bollinger_lower, CASE WHEN len(v) >= 21 THEN round(v[-1] / list_avg(v[-21:-2]), 6) END AS volume_ratio FROM s""")
def w8_technicals(spark, d):
    """Relative strength, MACD, Bollinger bands, volume ratio."""
    out = ops.technical_metrics(b.bars(spark, d))
    return rounded(out, [c for c in out.columns if c != "symbol"])


@query(f"""WITH {BARS_SQL}, l AS (SELECT symbol, max(date) FILTER (close <= 1500) AS bad FROM bars GROUP BY symbol)
SELECT symbol, count(*) AS n, min(date)::VARCHAR AS since FROM bars JOIN l USING (symbol) WHERE bad IS NULL OR date > bad GROUP BY symbol""")
def f14_valid_suffix(spark, d):
    """bars since the last invalid price (those up to 1500 are made so)."""
    bars = b.bars(spark, d).withColumn("close", F.when(F.col("close") <= 1500, F.lit(float("nan"))).otherwise(F.col("close")))
    return ops.valid_suffix(bars, "close").groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").cast("string").alias("since"))
