"""Price bars: snapshots, chart points and technical indicators, one shuffle by symbol for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite

SESSIONS_A_YEAR = 252


def valid_suffix(bars: DataFrame, value: str, positive: bool = True) -> DataFrame:
    """Bars after a symbol's last invalid value: missing, not finite, below zero, or (with positive) zero."""
    x = finite(F.col(value))
    bad = x.isNull() | ((x <= 0) if positive else (x < 0))
    last = F.max(F.when(bad, F.col("date"))).over(Window.partitionBy("symbol"))
    return bars.withColumn("_bad", last).where(F.col("_bad").isNull() | (F.col("date") > F.col("_bad"))).drop("_bad")


def positions(bars: DataFrame) -> DataFrame:
    """Bars with n (of the symbol's bars), back (0 for the latest), and values that need the bars before: prev, ret, true_range, peak."""
    by = Window.partitionBy("symbol").orderBy("date")
    whole = Window.partitionBy("symbol")
    bars = bars.withColumns({"pos": F.row_number().over(by), "n": F.count("*").over(whole), "prev": F.lag("close").over(by), "peak": F.max("close").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    gap = lambda c: F.abs(F.col(c) - F.col("prev"))
    return bars.withColumns({"back": F.col("n") - F.col("pos"), "ret": F.col("close") / F.col("prev") - 1, "true_range": F.greatest(F.col("high") - F.col("low"), gap("high"), gap("low"))})


def market_snapshot(bars: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """A row per symbol from its bars (symbol, date, open, high, low, close, volume): price, returns, extremes, risk, averages and their order.

    Returns over k sessions need more than k closes, averages of n closes n of them; what lacks is null. info (by symbol: currency, beta, ratios) is joined if given.
    """
    p = positions(bars.withColumns({c: finite(F.col(c)) for c in ("open", "high", "low", "close", "volume")}).where("close is not null"))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("close")))
    last = lambda n, c: F.avg(F.when(F.col("back") < n, F.col(c)))
    out = p.groupBy("symbol").agg(
        F.max("date").alias("observed_at"),
        F.max("n").alias("bars"),
        at(0).alias("price"),
        *[at(k).alias(f"close_{k}") for k in (1, 21, 126)],
        F.min_by("close", "date").alias("close_first"),
        F.max("high").alias("high_52w"),
        F.stddev_samp(F.when(F.col("back") < 20, F.col("ret"))).alias("sd"),
        last(20, "true_range").alias("atr_20"),
        (F.min(F.col("close") / F.col("peak") - 1) * 100).alias("max_drawdown_1y_pct"),
        last(20, "volume").alias("avg_volume_20d"),
        *[last(n, "close").alias(f"ma_{n}") for n in (20, 60, 100)],
    )
    change = lambda c: F.when(F.col(c) != 0, (F.col("price") / F.col(c) - 1) * 100)
    out = out.withColumns({f"ma_{n}": F.when(F.col("bars") >= n, F.col(f"ma_{n}")) for n in (20, 60, 100)})
    order = F.when(F.col("ma_100").isNull(), "이평 데이터 부족").when((F.col("ma_20") > F.col("ma_60")) & (F.col("ma_60") > F.col("ma_100")), "정배열").when((F.col("ma_20") < F.col("ma_60")) & (F.col("ma_60") < F.col("ma_100")), "역배열").otherwise("혼조")
    out = out.select(
        "symbol", "observed_at", "bars", "price", "high_52w", "atr_20", "max_drawdown_1y_pct", "avg_volume_20d", "ma_20", "ma_60", "ma_100",
        change("close_1").alias("return_1d_pct"), change("close_21").alias("return_1m_pct"), change("close_126").alias("return_6m_pct"),
        F.when(F.col("bars") >= 2, change("close_first")).alias("return_1y_pct"),
        (F.col("sd") * F.sqrt(F.lit(float(SESSIONS_A_YEAR))) * 100).alias("volatility_20d_pct"),
        F.when(F.col("high_52w") != 0, (F.col("price") / F.col("high_52w") - 1) * 100).alias("distance_from_high_pct"),
        order.alias("alignment"), *[(F.col("price") > F.col(f"ma_{n}")).alias(f"price_above_ma_{n}") for n in (20, 60, 100)],
    )
    return out.join(info, "symbol", "left") if info is not None else out


def chart_points(bars: DataFrame, limit: int = 120) -> DataFrame:
    """The latest bars of each symbol with their averages of 20, 60 and 100 closes, which look back on the whole history."""
    whole = bars.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in ("open", "high", "low", "close")))
    p = positions(whole)
    by = Window.partitionBy("symbol").orderBy("date")
    mean = lambda n: F.when(F.col("pos") >= n, F.avg("close").over(by.rowsBetween(1 - n, 0)))
    p = p.withColumns({f"ma_{n}": mean(n) for n in (20, 60, 100)})
    return p.where(F.col("back") < limit).select("symbol", "date", "open", "high", "low", "close", "ma_20", "ma_60", "ma_100")


def mean_weight(n: Column, i: Column, period: int, decay: float, share: float) -> Column:
    """The weight of the i-th of n values in a recursive mean begun by a plain mean of `period` values, in which each later value counts `share` and what was there `decay`."""
    return F.pow(F.lit(decay), n - F.greatest(i, F.lit(period))) * F.when(i <= period, 1 / period).otherwise(share)


def signal_weight(n: Column, i: Column, period: int, begin: int, smooth: int) -> Column:
    """The weight of the i-th of n values in a smoothed exponential mean: the mean over `period` from the value `begin` on, itself a series, smoothed over `smooth`.

    It is the sum over all steps t of the series of t's weight in the smoothing times the value's weight at t, two geometric sums in closed form: one over the plain mean of the first
    `smooth` steps, one over the rest.
    """
    a, c = 2 / (period + 1), 2 / (smooth + 1)
    q, r = 1 - a, 1 - c
    first = begin + smooth  # the first step after the plain mean
    power = lambda base, exponent: F.pow(F.lit(base), exponent)
    origin, step = F.greatest(i, F.lit(period)), F.greatest(i, F.lit(begin))
    plain = F.when(step < first, power(r, n - first + 1) / smooth * (power(q, step - origin) - power(q, first - origin)) / (1 - q)).otherwise(0.0)
    later = F.greatest(step, F.lit(first))
    m = F.greatest(n - later + 1, F.lit(0))
    rest = c * power(q, later - origin) * (power(r, m) - power(q, m)) / (r - q)
    return (plain + rest) * F.when(i <= period, 1 / period).otherwise(a)


def price_metrics(bars: DataFrame, strength: int = 14, fast: int = 12, slow: int = 26, smooth: int = 9, band: int = 20) -> DataFrame:
    """Per symbol rsi, macd, macd_signal and Bollinger bands at its latest bar.

    Wilder's averages and exponential means are linear in the prices, so each is a sum of prices times weights that follow from a bar's place alone: one aggregation, whatever the length of
    a history, and no list of it. Sums agree with the recursion to rounding.
    """
    p = positions(bars)
    n, i, x = F.col("n"), F.col("pos"), F.col("close").cast("double")
    wilder = mean_weight(n - 1, i - 1, strength, (strength - 1) / strength, 1 / strength)
    change = x - F.col("prev")
    mean = lambda period: mean_weight(n, i, period, 1 - 2 / (period + 1), 2 / (period + 1))
    near = F.when(F.col("back") < band, x)
    one = p.groupBy("symbol").agg(
        F.max("n").alias("n"),
        F.sum(F.when(i > 1, F.greatest(change, F.lit(0.0)) * wilder)).alias("gain"),
        F.sum(F.when(i > 1, F.greatest(-change, F.lit(0.0)) * wilder)).alias("loss"),
        F.sum(F.when(n >= slow, x * (mean(fast) - mean(slow)))).alias("macd"),
        F.sum(F.when(n >= slow + smooth - 1, x * (signal_weight(n, i, fast, slow, smooth) - signal_weight(n, i, slow, slow, smooth)))).alias("macd_signal"),
        F.when(F.count(near) >= band, F.avg(near)).alias("bollinger_middle"),
        F.when(F.count(near) >= band, 2 * F.stddev_pop(near)).alias("spread"),
    )
    scale = F.greatest("gain", "loss")
    value = F.when(scale == 0, F.lit(50.0)).otherwise(100 * (F.col("gain") / scale) / (F.col("gain") / scale + F.col("loss") / scale))
    return one.select(
        "symbol", F.when(n > strength, value).alias("rsi_14"), "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("macd_histogram"),
        "bollinger_middle", (F.col("bollinger_middle") + F.col("spread")).alias("bollinger_upper"), (F.col("bollinger_middle") - F.col("spread")).alias("bollinger_lower"),
    )


def technical_metrics(bars: DataFrame) -> DataFrame:
    """Per symbol rsi_14, macd with signal and histogram, Bollinger bands of 20 and volume ratio, each over the bars after the last invalid price or volume, however many they are."""
    symbols = bars.select("symbol").distinct()
    price = price_metrics(valid_suffix(bars, "close"))
    v = positions(valid_suffix(bars, "volume", positive=False))
    v = v.groupBy("symbol").agg(F.max("n").alias("n"), F.max(F.when(F.col("back") == 0, F.col("volume"))).alias("latest"), F.avg(F.when(F.col("back").between(1, 20), F.col("volume"))).alias("base"))
    v = v.select("symbol", F.when((F.col("n") >= 21) & (F.col("base") > 0), F.col("latest") / F.col("base")).alias("volume_ratio"))
    return symbols.join(price, "symbol", "left").join(v, "symbol", "left")
