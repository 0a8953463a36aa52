"""The indicator panel of a stock in long form, its compact form, and checks of ranking requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite, ratio

# Groups of indicators; of each its key, label, unit ("price": the price's currency, "statement": the statements'), description and formula.
PANEL = {
    "가치평가": [
        ("trailing_pe", "PER · 실적", "배", "이익 대비 주가 수준. 낮다고 항상 저평가는 아니며 적자 기업에는 부적합합니다.", "주가 ÷ 주당순이익(EPS). 공시 비율은 연간, Yahoo 값은 TTM 기준."),
        ("forward_pe", "PER · 예상", "배", "공급자의 예상 이익을 쓴 배수. 추정치가 바뀔 수 있으며 증권사 목표가가 아닙니다.", "주가 ÷ 예상 EPS"),
        ("price_to_book", "PBR", "배", "장부상 자기자본 대비 주가. 업종과 자산의 질에 따라 해석이 달라집니다.", "주가 ÷ 주당순자산(BPS)"),
        ("ev_ebitda", "EV/EBITDA", "배", "기업가치를 이자·세금·감가상각 전 이익과 비교합니다. 금융업에는 적합하지 않을 수 있습니다.", "기업가치(EV) ÷ EBITDA · 공급자 제공 비율"),
        ("eps", "EPS · TTM", "statement", "최근 12개월 주당순이익입니다. 희석주식수와 일회성 손익에 영향을 받습니다.", "주주귀속 순이익 ÷ 가중평균 주식수"),
        ("bps", "BPS", "statement", "보통주 한 주에 해당하는 장부상 순자산입니다.", "보통주 자기자본 ÷ 주식수"),
    ],
    "수익성·성장": [
        ("roe", "ROE", "%", "자기자본으로 얼마나 이익을 냈는지 보여줍니다. 부채 증가로 높아질 수도 있습니다.", "순이익 ÷ 평균 자기자본 × 100"),
        ("roa", "ROA", "%", "전체 자산 대비 수익성입니다. 자산이 많이 필요한 업종과 단순 비교하면 안 됩니다.", "순이익 ÷ 평균 총자산 × 100"),
        ("operating_margin", "영업이익률", "%", "본업 매출에서 영업이익으로 남은 비율입니다.", "영업이익 ÷ 매출 × 100"),
        ("profit_margin_pct", "순이익률", "%", "매출 대비 최종 순이익. 일회성 손익과 세금의 영향을 받습니다.", "순이익 ÷ 매출 × 100"),
        ("revenue_growth_pct", "매출 성장률", "%", "비교 기간 대비 매출 증가율입니다. 공급자와 공시의 비교 기간이 다를 수 있습니다.", "(당기 매출 ÷ 비교기 매출 − 1) × 100"),
    ],
    "현금흐름·재무안정성": [
        ("fcf", "잉여현금흐름 · 단순 FCF", "statement", "영업 현금에서 설비투자를 차감한 값. 순차입을 포함한 FCFE나 세후 영업이익 기반 FCFF와 다릅니다.", "영업현금흐름 − |자본적지출|"),
        ("fcf_yield", "FCF 수익률", "%", "최근 연간 FCF를 현재 시가총액과 비교합니다. 채무 구조와 업종도 함께 봐야 합니다.", "연간 단순 FCF ÷ 현재 시가총액 × 100"),
        ("net_debt", "순차입금", "statement", "총차입금에서 현금성 자산을 뺀 값. 음수이면 순현금 상태입니다.", "총차입금 − 현금 및 단기투자"),
        ("debt_equity", "차입금/자기자본", "%", "자기자본 대비 차입 부담. 총부채 비율과 다르며 자본잠식일 때 계산하지 않습니다.", "총차입금 ÷ 자기자본 × 100"),
        ("current_ratio", "유동비율", "%", "단기 채무를 유동자산으로 충당하는 능력입니다. 재고의 현금화 가능성도 확인해야 합니다.", "유동자산 ÷ 유동부채 × 100"),
    ],
    "추세·모멘텀·위험": [
        ("rsi_14", "RSI · 14일", "", "상승과 하락의 강도. 70/30은 관행적 과열/침체 구간이며 자동 매매 신호가 아닙니다.", "100 − 100/(1 + Wilder 평균상승/평균하락)"),
        ("macd", "MACD · 12/26", "price", "단기와 장기 지수이평 차이로 모멘텀을 확인합니다.", "EMA12 − EMA26"),
        ("macd_signal", "MACD 시그널 · 9", "price", "MACD의 완만한 추세선입니다. 교차 신호는 횡보장에서 잦은 오류가 생깁니다.", "MACD의 EMA9"),
        ("macd_histogram", "MACD 히스토그램", "price", "MACD와 시그널의 차이. 추세 가속·둔화를 살핍니다.", "MACD − 시그널"),
        ("bollinger_upper", "볼린저 상단 · 20일", "price", "최근 변동성에 따른 상단 범위. 상단 돌파가 곧 매도 신호는 아닙니다.", "SMA20 + 2 × 종가 표준편차(모집단)"),
        ("bollinger_middle", "볼린저 중심 · 20일", "price", "밴드 중심인 최근 20거래일 평균 종가입니다.", "SMA20"),
        ("bollinger_lower", "볼린저 하단 · 20일", "price", "최근 변동성에 따른 하단 범위. 미래가격 신뢰구간은 아닙니다.", "SMA20 − 2 × 종가 표준편차(모집단)"),
        ("volume_ratio", "거래량 배율", "배", "최근 거래량이 직전 20거래일 평균의 몇 배인지 보여줍니다.", "최근 거래량 ÷ 직전 20일 평균 거래량"),
        ("ma_20", "20일 이동평균", "price", "최근 거래일 종가의 평균으로 추세를 살핍니다. 후행 지표입니다.", "최근 20개 종가 평균"),
        ("ma_60", "60일 이동평균", "price", "최근 거래일 종가의 평균으로 추세를 살핍니다. 후행 지표입니다.", "최근 60개 종가 평균"),
        ("ma_100", "100일 이동평균", "price", "최근 거래일 종가의 평균으로 추세를 살핍니다. 후행 지표입니다.", "최근 100개 종가 평균"),
        ("atr_20", "ATR · 20일", "price", "갭을 포함한 가격 변동폭의 평균입니다. 방향을 예측하지 않습니다.", "최근 20일 True Range 단순평균"),
        ("volatility", "20일 연환산 변동성", "%", "최근 수익률의 흔들림을 연간 척도로 환산합니다.", "20일 일수익률 표본표준편차 × √252 × 100"),
        ("drawdown", "1년 최대 낙폭", "%", "조회 구간 내 고점에서 저점까지 가장 큰 하락입니다.", "min(종가 ÷ 이전 누적고점 − 1) × 100"),
        ("beta", "베타", "", "시장 변화에 대한 상대 민감도. 기준 지수와 추정 기간에 영향을 받습니다.", "공급자 제공 시장 대비 수익률 민감도"),
    ],
}
# Sources, periods where none is known, reasons why a value is missing, and what a panel says of its gaps.
QUOTE, QUOTE_RATIO = "Yahoo Finance", "Yahoo Finance · 제공 비율"
PERIODS = {"ratio": "공급자 기준 · 재무 기준일 미제공", "eps": "TTM · 종료일 미제공", "bps": "공급자 기준 · 결산일 미제공", "beta": "공급자 기준 · 추정 기간 미제공", "observed": "기준일 미제공", "statement": "결산일 미제공"}
REASONS = {
    "any": "공급자 값 또는 계산에 필요한 이력이 없습니다.", "filed_cap": "시가총액이 없거나 0 이하라 공시 기준 PER을 계산할 수 없습니다.", "filed_loss": "최근 연간 순이익이 0 이하라 PER을 계산하지 않습니다.", "filed_none": "에 PER 계산에 필요한 최근 연간 순이익이 없습니다.",
    "loss": "최근 12개월 EPS가 0 이하라 PER을 계산하지 않습니다.", "cap": "시가총액이 없거나 0 이하라 PER을 계산할 수 없습니다.", "none": "Yahoo Finance가 최근 12개월 PER을 제공하지 않았습니다.", "forward_pe": "Yahoo Finance가 예상 EPS 또는 예상 PER(forwardPE)을 제공하지 않았습니다.",
    "price_to_book": "양수 자기자본·BPS 또는 공급자 PBR이 없어 비교할 수 없습니다.", "ratio": "양수 이익·자본 또는 공급자 비율이 없어 비교가 어렵습니다.", "fcf_yield": "FCF·시가총액 누락 또는 재무·거래 통화 불일치/미확인입니다.",
}
GAPS = ["재무·거래 통화가 다르거나 확인되지 않아 통화를 섞는 가치 계산을 생략했습니다.", ("추가 지표 ", "개는 데이터 부족 또는 적용 불가로 계산하지 않았습니다."), "제공 비율의 기준일과 연간 공시 기간은 다를 수 있습니다. 실시간 체결가·증권사 컨센서스는 아닙니다."]
#: Ratios that a quote provides, filings taking precedence.
PROVIDED = ["trailing_pe", "forward_pe", "price_to_book", "ev_ebitda", "roe", "roa", "operating_margin", "profit_margin_pct", "revenue_growth_pct"]


def indicator_panel(snapshot: DataFrame, fundamentals: DataFrame | None = None) -> DataFrame:
    """(symbol, grp, pos, key, label, value, unit, description, formula, source, period, missing, reason) for each indicator of each symbol, from a wide snapshot with technicals and details where it has them.

    Ratios of filings take precedence over the quote's and bring their source and period. Multiples not above zero are missing; free cash flow needs both flows of one period; a yield needs statements in the price's
    currency. period says what a value's time is, or that it isn't known; reason says why a value is missing and is empty where there is one.
    """
    have = set(snapshot.columns)
    f = fundamentals.select("symbol", F.struct(*[c for c in fundamentals.columns if c != "symbol"]).alias("_f")) if fundamentals is not None else None
    s = snapshot.join(f, "symbol", "left") if f is not None else snapshot.withColumn("_f", F.lit(None).cast("struct<_none:int>"))
    filed = set(fundamentals.columns) - {"symbol"} if fundamentals is not None else set()
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in have else F.lit(None).cast("string")
    raw = lambda c: finite(F.col(c)) if c in have else F.lit(None).cast("double")
    told = lambda c, default: F.coalesce(F.col("_f").getField(c).cast("string"), F.lit(default)) if c in filed else F.lit(default)
    same = F.coalesce(text("currency") == text("financial_currency"), F.lit(False))
    one_period = text("ocf_period").eqNullSafe(text("capex_period"))
    fcf = F.when(one_period, raw("ocf") - F.abs(raw("capex")))
    made: dict[str, Column] = {
        "fcf": fcf, "fcf_yield": F.when(same, ratio(fcf, raw("market_cap"), 100.0)), "net_debt": raw("debt") - raw("cash"), "debt_equity": ratio(raw("debt"), raw("equity"), 100.0),
        "current_ratio": ratio(raw("current_assets"), raw("current_liabilities"), 100.0), "volatility": raw("volatility_20d_pct"), "drawdown": raw("max_drawdown_1y_pct"),
    }
    observed = F.coalesce(text("observed_at"), F.lit(PERIODS["observed"]))
    flows, balance, current = (F.coalesce(text(f"{c}_period"), F.lit(PERIODS["statement"])) for c in ("ocf", "debt", "current_assets"))
    periods = {"eps": F.lit(PERIODS["eps"]), "bps": F.lit(PERIODS["bps"]), "beta": F.lit(PERIODS["beta"]), "fcf": flows, "fcf_yield": F.concat(F.lit("재무 "), flows, F.lit(" / 시가총액 조회 시점")), "net_debt": balance, "debt_equity": balance, "current_ratio": current}
    no_cap, income = ~F.coalesce(raw("market_cap") > 0, F.lit(False)), raw("net_income")
    filed_pe = F.when(no_cap, REASONS["filed_cap"]).when(income <= 0, REASONS["filed_loss"]).otherwise(F.concat(told("source", ""), F.lit(REASONS["filed_none"])))
    quoted_pe = F.when(raw("eps") <= 0, REASONS["loss"]).when(no_cap, REASONS["cap"]).otherwise(REASONS["none"])
    reasons = {"trailing_pe": F.when(F.col("_f").isNotNull(), filed_pe).otherwise(quoted_pe), "forward_pe": F.lit(REASONS["forward_pe"]), "price_to_book": F.lit(REASONS["price_to_book"]), "fcf_yield": F.lit(REASONS["fcf_yield"])}
    rows = []
    for group, keys in PANEL.items():
        for key, label, unit, description, formula in keys:
            own = F.col("_f").getField(key) if key in filed else F.lit(None).cast("double")
            value = F.coalesce(finite(own), made[key] if key in made else raw(key))
            if unit == "배" and key != "volume_ratio":
                value = F.when(value > 0, value)
            shown = text("currency") if unit == "price" else text("financial_currency") if unit == "statement" else F.lit(unit)
            ratios = key in PROVIDED
            source = F.when(own.isNotNull(), told("source", "")).otherwise(QUOTE_RATIO if ratios else QUOTE)
            period = F.when(own.isNotNull(), told("period", "")).otherwise(F.lit(PERIODS["ratio"]) if ratios else periods.get(key, observed))
            reason = F.when(finite(value).isNotNull(), "").otherwise(reasons.get(key, F.lit(REASONS["ratio" if ratios else "any"])))
            fields = {"grp": F.lit(group), "pos": F.lit(len(rows)), "key": F.lit(key), "label": F.lit(label), "value": finite(value), "unit": F.coalesce(shown, F.lit("통화 미제공")), "description": F.lit(description), "formula": F.lit(formula), "source": source, "period": period, "reason": reason}
            rows.append(F.struct(*[c.alias(name) for name, c in fields.items()]))
    out = s.select("symbol", F.inline(F.array(*rows)))
    return out.withColumn("missing", F.col("value").isNull())


def panel_gaps(snapshot: DataFrame, panel: DataFrame) -> DataFrame:
    """(symbol, gaps): what a panel says is lacking: values that would mix currencies, how many indicators have none, and that periods differ."""
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in snapshot.columns else F.lit(None).cast("string")
    same = F.coalesce(text("currency") == text("financial_currency"), F.lit(False))
    count = panel.groupBy("symbol").agg(F.count_if("missing").alias("m"))
    many = F.when(F.col("m") > 0, F.concat(F.lit(GAPS[1][0]), F.col("m").cast("string"), F.lit(GAPS[1][1])))
    return snapshot.select("symbol", same.alias("same")).join(count, "symbol").select("symbol", F.array_compact(F.array(F.when(~F.col("same"), GAPS[0]), many, F.lit(GAPS[2]))).alias("gaps"))


def missing_counts(panel: DataFrame) -> DataFrame:
    """(symbol, grp, missing): how many indicators of a group have no value."""
    return panel.groupBy("symbol", "grp").agg(F.count_if("missing").alias("missing"))


def compact_panel(panel: DataFrame) -> DataFrame:
    """(symbol, metrics): the indicators that have values, in order, without descriptions."""
    one = panel.where(~F.col("missing")).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "label", "value", "unit", "source", "period"))).alias("m"))
    return one.select("symbol", F.transform("m", lambda x: F.struct(*[x[c].alias(c) for c in ("key", "label", "value", "unit", "source", "period")])).alias("metrics"))


def to_panel_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as JSON."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("json"))


def validate_candidates(df: DataFrame, most: int = 5000) -> DataFrame:
    """df with error: why a candidate row of a ranking request is refused, null if it isn't. Requests (request_id, if there is one) have at most so many rows."""
    from pyspark.sql import Window

    numbers = ["price", "atr_20", "quality", "value", "momentum", "revisions", "news", "liquidity", "drawdown", "beta", "stale_ratio"]
    error = F.when(F.trim(F.coalesce("symbol", F.lit(""))) == "", "symbol")
    for c in numbers:
        v = finite(F.col(c))
        error = error.when(v.isNull() | (v < 0), c)
    error = error.when(F.col("stale_ratio") > 1, "stale_ratio")
    if "request_id" in df.columns:
        error = error.when(F.count("*").over(Window.partitionBy("request_id")) > most, "too many rows")
    return df.withColumn("error", error)
