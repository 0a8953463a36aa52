"""Factor scores, regime, cross-sectional ranking, price plans and rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite, interpolate, mean_of
from tidemark.sources.tables import kept

# Fixed values: (input, score) points of each factor's inputs.
MOMENTUM = {
    "return_1m_pct": [(-20, 0), (0, 50), (20, 100)],
    "return_6m_pct": [(-40, 0), (0, 50), (50, 100)],
    "return_1y_pct": [(-50, 0), (0, 50), (100, 100)],
    "distance_from_high_pct": [(-60, 0), (-20, 50), (0, 100)],
}
VALUE = {
    "trailing_pe": [(5, 100), (15, 70), (30, 40), (60, 0)],
    "price_to_book": [(0.5, 100), (1.5, 70), (4, 40), (10, 0)],
}
QUALITY = {
    "gross_margin_pct": [(0, 0), (20, 50), (50, 100)],
    "profit_margin_pct": [(-20, 0), (0, 50), (25, 100)],
    "revenue_growth_pct": [(-20, 0), (0, 50), (30, 100)],
}
LIQUIDITY = {
    "KRW": [(1e8, 0), (1e9, 40), (1e10, 70), (1e11, 100)],
    "USD": [(1e5, 0), (1e6, 40), (1e7, 70), (1e8, 100)],
}
# What a price history alone must give.
CORE = ["price", "return_1m_pct", "return_6m_pct", "return_1y_pct", "avg_volume_20d", "volatility_20d_pct", "max_drawdown_1y_pct"]
# Weights without risk aversion and what it adds.
WEIGHTS = {"quality": (0.22, 0.07), "value": (0.17, 0.03), "momentum": (0.21, -0.05), "revisions": (0.20, 0.0), "news": (0.10, 0.0)}
RISK_WEIGHT, NEWS_COVERAGE, LEAST_LIQUIDITY, MOST_STALE = 0.10, 0.60, 35.0, 0.15
INPUTS = [*CORE, "distance_from_high_pct", "trailing_pe", "price_to_book", "gross_margin_pct", "profit_margin_pct", "revenue_growth_pct", "atr_20", "beta"]


def news_factor(bridge: DataFrame, articles: DataFrame, insights: DataFrame, limit: int = 20) -> DataFrame:
    """(symbol, news, news_observations): mean sentiment score of a symbol's latest analysed articles; 50 and 0 if none has a score."""
    rows = bridge.select("symbol", "article_id").join(articles.select("article_id", "published_at"), "article_id").join(insights.select("article_id", "sentiment_score"), "article_id")
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc_nulls_first("published_at"), F.desc("article_id")))
    return news_mean(rows.withColumn("_n", n).where(F.col("_n") <= limit))


def news_mean(rows: DataFrame) -> DataFrame:
    """(symbol, news, news_observations) over all rows (symbol, sentiment_score)."""
    score = finite(F.col("sentiment_score"))
    return rows.groupBy("symbol").agg(F.coalesce(F.avg(score), F.lit(50.0)).alias("news"), F.count(score).alias("news_observations"))


def overlay_fundamentals(snapshot: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """A snapshot with the fundamentals' values where they are there."""
    names = [c for c in fundamentals.columns if c != "symbol"]
    f = fundamentals.select("symbol", F.struct(*names).alias("_f"))
    out = snapshot.join(f, "symbol", "left")
    both = [F.coalesce(F.col("_f").getField(c), F.col(c)).alias(c) if c in snapshot.columns else F.col("_f").getField(c).alias(c) for c in names]
    return out.select(*[c for c in snapshot.columns if c not in names], *both)


def score_snapshot(snapshot: DataFrame, news: DataFrame, fundamentals: DataFrame | None = None) -> DataFrame:
    """Factor scores from 0 to 100 of each symbol, with coverage (inputs that were there) and what the ranking needs; a missing factor is neutral."""
    s = overlay_fundamentals(snapshot, fundamentals) if fundamentals is not None else snapshot
    s = s.select("symbol", *[c for c in ("as_of", "currency") if c in s.columns], *[(finite(F.col(c)) if c in s.columns else F.lit(None).cast("double")).alias(c) for c in INPUTS])
    if "currency" not in s.columns:
        s = s.withColumn("currency", F.lit("USD"))
    s = s.join(news, "symbol", "left")
    groups = {"momentum": MOMENTUM, "value": VALUE, "quality": QUALITY}
    s = s.withColumns({f"_{c}": interpolate(F.col(c), points) for curves in groups.values() for c, points in curves.items()})
    factor = {n: mean_of([F.col(f"_{c}") for c in curves]) for n, curves in groups.items()}
    turnover = F.when(F.col("price") > 0, F.col("avg_volume_20d") * F.col("price"))
    liquid = F.when(F.upper("currency") == "KRW", interpolate(turnover, LIQUIDITY["KRW"])).otherwise(interpolate(turnover, LIQUIDITY["USD"]))
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in CORE), F.lit(0))
    observed = F.coalesce("news_observations", F.lit(0))
    coverage = F.create_map(*[x for n in factor for x in (F.lit(n), factor[n][1])], F.lit("liquidity"), F.when(liquid.isNotNull(), 1).otherwise(0), F.lit("news"), observed.cast("int"), F.lit("revisions"), F.lit(0))
    return s.select(
        "symbol", *[c for c in ("as_of",) if c in s.columns], F.coalesce("price", F.lit(0.0)).alias("price"), F.coalesce("atr_20", F.lit(0.0)).alias("atr_20"),
        *[factor[n][0].alias(n) for n in ("quality", "value", "momentum")], F.lit(50.0).alias("revisions"), F.coalesce("news", F.lit(50.0)).alias("news"),
        F.coalesce(liquid, F.lit(50.0)).alias("liquidity"), F.coalesce(F.abs("max_drawdown_1y_pct"), F.lit(0.0)).alias("drawdown"),
        F.coalesce(F.nullif("beta", F.lit(0.0)), F.lit(1.0)).alias("beta"), (1 - filled / len(CORE)).alias("stale_ratio"), observed.alias("news_observations"), coverage.alias("coverage"),
    )


def fit_to_rank() -> Column:
    """Whether a scored symbol has a price, is liquid and isn't stale."""
    return (F.col("price") > 0) & (F.col("liquidity") >= LEAST_LIQUIDITY) & (F.col("stale_ratio") <= MOST_STALE)


def eligible(scores: DataFrame) -> DataFrame:
    """Symbols that take part in the ranking."""
    return scores.where(fit_to_rank())


def rejections(scores: DataFrame, ranked: DataFrame) -> DataFrame:
    """(symbol, reason) for symbols that aren't ranked."""
    reason = (
        F.when(F.col("price") <= 0, "가격 정보를 받지 못했습니다.")
        .when(F.col("liquidity") < LEAST_LIQUIDITY, F.concat(F.lit("거래대금이 기준에 미달합니다(유동성 점수 "), F.format_string("%.0f", "liquidity"), F.lit(" < 35).")))
        .when(F.col("stale_ratio") > MOST_STALE, F.concat(F.lit("시세 데이터가 너무 많이 비었습니다(결측 비율 "), F.format_string("%.0f%%", F.col("stale_ratio") * 100), F.lit(").")))
        .otherwise("정량 순위 기준을 통과하지 못했습니다.")
    )
    return scores.join(ranked.select("symbol"), "symbol", "left_anti").select("symbol", reason.alias("reason"))


def risk_off(vix: Column, usdkrw: Column, credit: Column) -> Column:
    """Risk aversion from 0 to 1."""
    raw = (vix - 18) / 8 + F.greatest(usdkrw, F.lit(0.0)) / 6 + F.greatest(credit, F.lit(0.0)) / 40
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + F.exp(-raw)) - 0.35))


def macro_regime(series: DataFrame, sessions: int = 20, neutral_vix: float = 18.0) -> DataFrame:
    """One row from (name, date, close) of vix, usdkrw and us10y: levels and changes over sessions, neutral where a series lacks, and which were there."""
    n = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("date")))
    rows = series.where(finite(F.col("close")).isNotNull()).withColumn("_n", n).where(F.col("_n").isin(1, sessions + 1))
    at = lambda name, k: F.max(F.when((F.col("name") == name) & (F.col("_n") == k), F.col("close")))
    r = rows.agg(at("vix", 1).alias("v"), *[at(s, k).alias(f"{s}_{k}") for s in ("usdkrw", "us10y") for k in (1, sessions + 1)])
    krw = F.when(F.col(f"usdkrw_{sessions + 1}") != 0, (F.col("usdkrw_1") / F.col(f"usdkrw_{sessions + 1}") - 1) * 100)
    ten = (F.col("us10y_1") - F.col(f"us10y_{sessions + 1}")) * 100
    return r.select(F.coalesce("v", F.lit(neutral_vix)).alias("vix"), F.coalesce(krw, F.lit(0.0)).alias("usdkrw_change_20d"), F.coalesce(ten, F.lit(0.0)).alias("us10y_change_bp_20d"), F.lit(0.0).alias("credit_spread_change_bp_20d"), F.col("v").isNotNull().alias("has_vix"), krw.isNotNull().alias("has_usdkrw"), ten.isNotNull().alias("has_us10y"))


def trade_plan(price: Column, atr: Column, aversion: Column) -> Column:
    """struct(entry_low, entry_high, stop, target); null unless price and range are above zero."""
    stop = price - atr * F.greatest(F.lit(0.8), 1.8 - aversion * 0.6)
    target = price + (price - stop) * F.greatest(F.lit(1.6), 2.2 - aversion * 0.4)
    return F.when((price > 0) & (atr > 0), F.struct((price - atr * 0.55).alias("entry_low"), (price - atr * 0.15).alias("entry_high"), stop.alias("stop"), target.alias("target")))


#: Parts of equal count into which a group is cut, and how exactly the sketch knows where they end (a tenth of a part at worst).
PARTS, EXACTNESS = 1000, 20_000


def order_statistics(values: DataFrame, by: list[str], low: Column, high: Column) -> DataFrame:
    """(by, lo, hi): of the values (by, v) of each group those at two ranks from 1 on, given as expressions over its count n.

    A sketch of quantiles says between which values a rank lies, however they are spread; only values in there, some three in PARTS and repeats of them, are put in order, those below are counted.
    """
    rows = values.where("v is not null")
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", [i / PARTS for i in range(PARTS + 1)], EXACTNESS).alias("q"))
    at = lambda rank, more: F.floor(F.col(rank) / F.col("n") * PARTS).cast("int") + 1 + more
    least, most = F.lit(float("-inf")), F.lit(float("inf"))
    begin = lambda rank: F.when(at(rank, -1) > 1, F.element_at("q", F.greatest(F.lit(1), at(rank, -1)))).otherwise(least)
    end = lambda rank: F.when(at(rank, 2) <= PARTS, F.element_at("q", F.least(F.lit(PARTS + 1), at(rank, 2)))).otherwise(most)
    ranks = sketch.withColumns({"r_lo": low, "r_hi": high})
    ranks = ranks.select(*by, "r_lo", "r_hi", *[f(f"r_{k}").alias(f"{name}_{k}") for k in ("lo", "hi") for name, f in (("a", begin), ("b", end))])
    counts = rows.groupBy(*by, "v").agg(F.count("*").alias("c")).join(ranks, by)
    below = counts.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("v") < F.col(f"a_{k}"), F.col("c"))), F.lit(0)).alias(f"under_{k}") for k in ("lo", "hi")])
    near = counts.select(*by, "v", "c", F.explode(F.array(*[F.when(F.col("v").between(F.col(f"a_{k}"), F.col(f"b_{k}")), F.struct(F.lit(k).alias("k"), F.col(f"r_{k}").alias("r"))) for k in ("lo", "hi")])).alias("w")).where("w is not null")
    so_far = F.sum("c").over(Window.partitionBy(*by, "w.k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("so_far", so_far).join(below, by)
    reached = lambda k: (F.col("w.k") == k) & (F.col("so_far") + F.col(f"under_{k}") >= F.col("w.r"))
    return near.groupBy(*by).agg(*[F.min(F.when(reached(k), F.col("v"))).alias(k) for k in ("lo", "hi")])


def winsorized_z(df: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """df with z_<name> for each name: values clipped at their 5 % order statistics within `by`, standardised by the population's deviation; 0 if it has none."""
    low, high = F.greatest(F.lit(0), F.floor(F.col("n") * 0.05) - 1) + 1, F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)) + 1
    values = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("v")) for c in names])))
    ends = order_statistics(values, [*by, "_name"], low, high)
    at = lambda c, k: F.max(F.when(F.col("_name") == c, F.col(k))).alias(f"_{k}_{c}")
    clipped = df.join(ends.groupBy(*by).agg(*[at(c, k) for c in names for k in ("lo", "hi")]), by)
    clipped = clipped.withColumns({f"_c_{c}": F.least(F.col(f"_hi_{c}"), F.greatest(F.col(f"_lo_{c}"), F.col(c))) for c in names})
    moments = clipped.groupBy(*by).agg(*[f(f"_c_{c}").alias(f"_{k}_{c}") for c in names for k, f in (("avg", F.avg), ("sd", F.stddev_pop))])
    z = {f"z_{c}": F.when(F.col(f"_sd_{c}") > 0, (F.col(f"_c_{c}") - F.col(f"_avg_{c}")) / F.col(f"_sd_{c}")).otherwise(0.0) for c in names}
    return clipped.join(moments, by).withColumns(z).drop(*[f"_{k}_{c}" for c in names for k in ("lo", "hi", "c", "avg", "sd")])


def rank(scores: DataFrame, regime: DataFrame, limit: int | None = 5, by: tuple[str, ...] = ("as_of",)) -> DataFrame:
    """The best symbols of each group by score: rank, score, confidence, action, plan and the two strongest factors.

    regime is one row, or a row for each group. News counts only if enough of the group's symbols have any. Symbols without a plan are dropped
    after standardising. Scores are ranked as rounded to a tenth, ties by symbol.
    """
    by = list(by)
    fit = kept(eligible(scores))  # read once for each statistic
    z = winsorized_z(fit, list(WEIGHTS), by)
    covered = fit.groupBy(*by).agg((F.avg((F.col("news_observations") > 0).cast("double")) >= NEWS_COVERAGE).alias("news_on"))
    z = z.join(covered, by)
    r = regime.select(*[c for c in by if c in regime.columns], risk_off(F.col("vix"), F.col("usdkrw_change_20d"), F.col("credit_spread_change_bp_20d")).alias("aversion"))
    keyed = [c for c in by if c in regime.columns]
    z = z.join(r, keyed) if keyed else z.crossJoin(F.broadcast(r))  # one row
    norm = {n: 50 + 18 * F.col(f"z_{n}") for n in WEIGHTS}
    weight = {n: F.lit(w) + F.lit(more) * F.col("aversion") for n, (w, more) in WEIGHTS.items()}
    weight["news"] = F.when(F.col("news_on"), weight["news"]).otherwise(0.0)
    risk = F.greatest(F.lit(0.0), 100 - F.col("drawdown") * 1.8 - F.col("beta") * 12 - F.col("aversion") * 18)
    raw = sum((norm[n] * weight[n] for n in WEIGHTS), F.lit(0.0)) + risk * RISK_WEIGHT
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw / (sum(weight.values(), F.lit(0.0)) + RISK_WEIGHT)))
    z = z.withColumns({"score": score, "plan": trade_plan(F.col("price"), F.col("atr_20"), F.col("aversion"))}).where("plan is not null")
    action = F.when((F.col("score") >= 72) & (F.col("plan.target") / F.col("price") - 1 >= 0.08), "매수 유효").otherwise("관찰")
    confidence = F.least(F.lit(92.0), F.col("score") * 0.72 + (1 - F.col("stale_ratio")) * 16 + F.when(F.col("news_observations") > 0, 4).otherwise(0))
    strongest = F.array(*[F.struct((-norm[n]).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(WEIGHTS)])
    strongest = F.slice(F.sort_array(F.filter(strongest, lambda x: F.col("news_on") | (x["name"] != "news"))), 1, 2)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 1)), "symbol"))
    out = z.withColumn("rank", place)
    out = out.where(F.col("rank") <= limit) if limit is not None else out
    return out.select(*by, "rank", "symbol", "score", confidence.alias("confidence"), action.alias("action"), "plan.entry_low", "plan.entry_high", "plan.stop", "plan.target", F.transform(strongest, lambda x: x["name"]).alias("reasons"))
