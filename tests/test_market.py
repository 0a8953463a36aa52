"""Bars, technicals, scores and ranking with known values."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import market, ranking

PRICES = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46.00]


def bars(spark, closes, volumes=None, symbol="S"):
    """Bars of one symbol, a day each."""
    rows = [(symbol, date(2024, 1, 1) + timedelta(days=i), c, c, c, c, v) for i, (c, v) in enumerate(zip(closes, volumes or [1.0] * len(closes), strict=True))]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def one(df):
    """The only row."""
    (row,) = df.collect()
    return row


def test_relative_strength(spark):
    assert one(market.technical_metrics(bars(spark, PRICES[:15]))).rsi_14 == pytest.approx(70.4641350211)
    assert one(market.technical_metrics(bars(spark, PRICES))).rsi_14 == pytest.approx(66.2496185536)
    assert one(market.technical_metrics(bars(spark, [5.0] * 15))).rsi_14 == 50
    assert one(market.technical_metrics(bars(spark, [20.0 - i for i in range(16)]))).rsi_14 == 0
    assert one(market.technical_metrics(bars(spark, PRICES[:14]))).rsi_14 is None


def test_macd_and_bands(spark):
    r = one(market.technical_metrics(bars(spark, [float(i) for i in range(1, 27)])))
    assert r.macd == pytest.approx(7) and r.macd_signal is None
    r = one(market.technical_metrics(bars(spark, [float(i) for i in range(1, 35)])))
    assert r.macd == pytest.approx(7) and r.macd_signal == pytest.approx(7)
    r = one(market.technical_metrics(bars(spark, [100.0] * 34 + [110.0])))
    assert r.macd == pytest.approx(10 * (2 / 13 - 2 / 27))
    r = one(market.technical_metrics(bars(spark, [float(i) for i in range(1, 21)])))
    assert r.bollinger_middle == pytest.approx(10.5) and r.bollinger_upper == pytest.approx(10.5 + 2 * 33.25**0.5)


def test_volume_ratio_and_invalid_values(spark):
    assert one(market.technical_metrics(bars(spark, [1.0] * 21, [100.0] * 20 + [250.0]))).volume_ratio == pytest.approx(2.5)
    assert one(market.technical_metrics(bars(spark, [1.0] * 21, [0.0] * 20 + [5.0]))).volume_ratio is None
    for bad in (float("nan"), float("inf"), -1.0, 0.0, None):
        r = one(market.technical_metrics(bars(spark, [1.0] * 5 + [bad] + PRICES)))
        assert r.rsi_14 == pytest.approx(66.2496185536) and r.volume_ratio == pytest.approx(1.0)
    r = one(market.technical_metrics(bars(spark, PRICES + [1.0] * 10, [-1.0] + [1.0] * 25)))
    assert r.rsi_14 is not None


def folded(prices, volumes=None):
    """RSI, MACD and its signal by recursion over a list."""

    def mean(values, n):
        out = [sum(values[:n]) / n]
        for x in values[n:]:
            out.append(2 / (n + 1) * x + (1 - 2 / (n + 1)) * out[-1])
        return out

    rsi = macd = signal = None
    if len(prices) >= 15:
        changes = [b - a for a, b in zip(prices, prices[1:])]
        gain, loss = (sum(max(s * c, 0) for c in changes[:14]) / 14 for s in (1, -1))
        for c in changes[14:]:
            gain, loss = gain * 13 / 14 + max(c, 0) / 14, loss * 13 / 14 + max(-c, 0) / 14
        rsi = 50.0 if gain == loss == 0 else 100 * gain / (gain + loss)
    if len(prices) >= 26:
        series = [f - s for f, s in zip(mean(prices, 12)[14:], mean(prices, 26))]
        macd = series[-1]
        signal = mean(series, 9)[-1] if len(series) >= 9 else None
    return rsi, macd, signal


def test_weighted_sums_equal_the_recursion(spark):
    r = random.Random(3)
    lengths = [*range(12, 45), 60, 100, 252, 1000, 4000]
    prices = {f"S{n}": [round(50 + 10 * r.random() + (i % 90) / 9, 4) for i in range(n)] for n in lengths}
    rows = [(s, date(2000, 1, 1) + timedelta(days=i), c, c, c, c, 1.0) for s, p in prices.items() for i, c in enumerate(p)]
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    got = {x.symbol: x for x in market.technical_metrics(df).collect()}
    for s, p in prices.items():
        assert (got[s].rsi_14, got[s].macd, got[s].macd_signal) == pytest.approx(folded(p), abs=1e-9), s


def test_no_history_is_a_list(spark, capsys):
    market.technical_metrics(bars(spark, PRICES)).explain()
    assert "collect_" not in capsys.readouterr().out


def test_order_statistics_under_outliers_and_ties(spark):
    r = random.Random(4)
    groups = {"plain": [r.gauss(0, 1) for _ in range(5000)], "outlier": [r.random() for _ in range(4999)] + [1e12], "ties": [float(r.randint(0, 3)) for _ in range(3000)], "two": [2.0, 1.0], "one": [7.0], "same": [1.0] * 500, "low": [-1e300] * 30 + [float(i) for i in range(70)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("plain", None)], "g string, v double")
    n = F.col("n")
    for share in (0.05, 0.5, 0.95):
        low, high = F.greatest(F.lit(0), F.floor(n * share) - 1) + 1, F.least(n - 1, F.floor(n * share)) + 1
        got = {x.g: (x.lo, x.hi) for x in ranking.order_statistics(df, ["g"], low, high).collect()}
        for g, vs in groups.items():
            s = sorted(vs)
            assert got[g] == (s[max(0, int(len(s) * share) - 1)], s[min(len(s) - 1, int(len(s) * share))]), (g, share)


def test_averages(spark):
    r = one(market.market_snapshot(bars(spark, [float(i) for i in range(1, 121)])))
    assert (r.ma_20, r.ma_60, r.ma_100, r.alignment) == (110.5, 90.5, 70.5, "정배열") and r.price_above_ma_100
    assert one(market.market_snapshot(bars(spark, [float(i) for i in range(120, 0, -1)]))).alignment == "역배열"
    r = one(market.market_snapshot(bars(spark, [float(i) for i in range(1, 60)])))
    assert r.alignment == "이평 데이터 부족" and r.ma_60 is None and r.price_above_ma_60 is None and r.return_6m_pct is None
    assert market.chart_points(bars(spark, [float(i) for i in range(1, 151)])).count() == 120


def candidate(symbol, **other):
    """A scored symbol."""
    base = {"symbol": symbol, "price": 100.0, "atr_20": 3.0, "quality": 60.0, "value": 50.0, "momentum": 70.0, "revisions": 50.0, "news": 50.0, "liquidity": 80.0, "drawdown": 10.0, "beta": 1.0, "stale_ratio": 0.0, "news_observations": 1, "as_of": "d"}
    return base | other


def regime(spark, vix=18.0):
    """A calm regime."""
    return spark.createDataFrame([(vix, 0.0, 0.0, 0.0)], "vix double, usdkrw_change_20d double, us10y_change_bp_20d double, credit_spread_change_bp_20d double")


def test_rank(spark):
    rows = [candidate(f"S{i}", quality=50.0 + i, momentum=90.0 - 3 * i) for i in range(8)] + [candidate("stale", stale_ratio=0.5), candidate("thin", liquidity=10.0), candidate("flat", atr_20=0.0)]
    scores = spark.createDataFrame(rows)
    got = ranking.rank(scores, regime(spark)).collect()
    assert len(got) == 5 and [r["rank"] for r in got] == [1, 2, 3, 4, 5] and not {"stale", "thin", "flat"} & {r.symbol for r in got}
    assert got[0].entry_low == pytest.approx(98.35) and got[0].entry_high == pytest.approx(99.55)
    assert all(len(r.reasons) == 2 for r in got)
    reasons = {r.symbol: r.reason for r in ranking.rejections(scores, ranking.rank(scores, regime(spark), None)).collect()}
    assert reasons["stale"].startswith("시세") and reasons["thin"] == "거래대금이 기준에 미달합니다(유동성 점수 10 < 35)." and reasons["flat"].startswith("정량")
    none = spark.createDataFrame([candidate(f"S{i}", news_observations=0, news=float(i)) for i in range(5)])
    assert "news" not in {x for r in ranking.rank(none, regime(spark)).collect() for x in r.reasons}


def test_scores(spark):
    snapshot = spark.createDataFrame([("A", 100.0, "USD", None), ("B", 100.0, "KRW", 2e6)], "symbol string, price double, currency string, avg_volume_20d double")
    news = spark.createDataFrame([("A", 80.0, 2)], "symbol string, news double, news_observations long")
    got = {r.symbol: r for r in ranking.score_snapshot(snapshot, news).collect()}
    assert got["A"].stale_ratio == pytest.approx(6 / 7) and got["A"].momentum == got["A"].value == 50 and got["A"].news == 80 and got["A"].beta == 1
    assert got["B"].liquidity == pytest.approx(0 + (2e8 - 1e8) / 9e8 * 40) and got["B"].coverage["liquidity"] == 1 and got["B"].news == 50
