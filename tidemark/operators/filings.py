"""Filings and statements: facts, fundamentals, filer profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite

# Forms, names of reporting regimes, concepts in order of preference, codes of US states.
ANNUAL = ["10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A"]
DOMESTIC = ["10-K", "10-K/A", "10-Q", "10-Q/A"]
FOREIGN = ["20-F", "20-F/A", "40-F", "40-F/A"]
CURRENT = ["6-K", "6-K/A"]
REGIMES = ["미국 내국법인 양식(10-K·10-Q)", "미국 기준 외국법인 양식(20-F)", "미국 기준 외국법인 양식(6-K 중심)", "미상"]
CONCEPTS = {
    "revenue": [("us-gaap", "RevenueFromContractWithCustomerExcludingAssessedTax"), ("us-gaap", "SalesRevenueNet"), ("us-gaap", "Revenues"), ("ifrs-full", "Revenue")],
    "income": [("us-gaap", "NetIncomeLoss"), ("ifrs-full", "ProfitLoss")],
    "equity": [("us-gaap", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"), ("us-gaap", "StockholdersEquity"), ("ifrs-full", "Equity")],
}
STATES = "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY PR VI GU AS MP X1".split()
ACCOUNTS = {"revenue": "매출액", "income": "당기순이익", "equity": "자본총계"}
FACTS = "map<string,map<string,struct<units:map<string,array<struct<form:string,end:string,filed:string,val:double>>>>>>"


def sec_facts(raw: DataFrame) -> DataFrame:
    """Facts (cik, taxonomy, concept, unit, unit_pos, pos, form, end, filed, val) of company fact files (cik, json); only known concepts are spelled out."""
    wanted = [c for pairs in CONCEPTS.values() for _, c in pairs]
    a = raw.select("cik", F.explode(F.from_json("json", f"facts {FACTS}")["facts"]).alias("taxonomy", "concepts"))
    a = a.select("cik", "taxonomy", F.explode(F.map_filter("concepts", lambda k, _: k.isin(wanted))).alias("concept", "body"))
    a = a.select("cik", "taxonomy", "concept", F.posexplode("body.units").alias("unit_pos", "unit", "rows"))
    return a.select("cik", "taxonomy", "concept", "unit", "unit_pos", F.posexplode("rows").alias("pos", "r")).select("cik", "taxonomy", "concept", "unit", "unit_pos", "pos", "r.form", "r.end", "r.filed", "r.val")


def annual_facts(facts: DataFrame) -> DataFrame:
    """(cik, item, period, value, nth): per item the first concept and unit that has annual values, per period the latest filed, the newest period first."""
    order = F.lit(None).cast("struct<item:string,rank:int>")
    for item, pairs in CONCEPTS.items():
        for i, (taxonomy, concept) in enumerate(pairs):
            order = F.when((F.col("taxonomy") == taxonomy) & (F.col("concept") == concept), F.struct(F.lit(item).alias("item"), F.lit(i).alias("rank"))).otherwise(order)
    a = facts.withColumn("o", order).where("o is not null").where(F.col("form").isin(ANNUAL) & finite(F.col("val")).isNotNull() & (F.coalesce("end", F.lit("")) != "") & (F.coalesce("filed", F.lit("")) != ""))
    a = a.withColumn("best", F.min(F.struct("o.rank", "unit_pos")).over(Window.partitionBy("cik", "o.item")))
    a = a.where((F.col("o.rank") == F.col("best.rank")) & (F.col("unit_pos") == F.col("best.unit_pos")))
    a = a.groupBy("cik", F.col("o.item").alias("item"), F.col("end").alias("period")).agg(F.max_by("val", F.struct("filed", -F.col("pos"))).alias("value"))
    return a.withColumn("nth", F.row_number().over(Window.partitionBy("cik", "item").orderBy(F.desc("period"))))


def ratios(revenue: Column, previous: Column, income: Column, equity: Column, cap: Column) -> list[Column]:
    """Growth, margin, price to earnings and to book; those by income and equity only where these are above zero."""
    return [
        F.when((cap > 0) & (income > 0), cap / income).alias("trailing_pe"),
        F.when((cap > 0) & (equity > 0), cap / equity).alias("price_to_book"),
        F.when(revenue != 0, income / revenue * 100).alias("profit_margin_pct"),
        F.when(previous != 0, (revenue / previous - 1) * 100).alias("revenue_growth_pct"),
    ]


def any_ratio() -> Column:
    """Whether a row of fundamentals says anything."""
    return F.coalesce("trailing_pe", "price_to_book", "profit_margin_pct", "revenue_growth_pct").isNotNull()


def sec_fundamentals(facts: DataFrame, market_caps: DataFrame) -> DataFrame:
    """(cik, source, period, ratios): income and equity of the latest revenue's period, else their own latest; companies without any ratio go."""
    a = annual_facts(facts)
    latest = a.where("item = 'revenue' and nth = 1").select("cik", F.col("period").alias("rp"))
    a = a.join(latest, "cik", "left")
    at = lambda item: F.coalesce(F.max(F.when((F.col("item") == item) & (F.col("period") == F.col("rp")), F.col("value"))), F.max(F.when((F.col("item") == item) & (F.col("nth") == 1), F.col("value"))))
    nth = lambda n: F.max(F.when((F.col("item") == "revenue") & (F.col("nth") == n), F.col("value")))
    one = a.groupBy("cik").agg(F.coalesce(F.max("rp"), F.lit("")).alias("period"), nth(1).alias("revenue"), nth(2).alias("previous"), at("income").alias("income"), at("equity").alias("equity"))
    one = one.join(market_caps.select("cik", finite(F.col("market_cap")).alias("cap")), "cik", "left")
    return one.select("cik", F.lit("SEC EDGAR").alias("source"), "period", *ratios(*[F.col(c) for c in ("revenue", "previous", "income", "equity", "cap")])).where(any_ratio())


def amount(c: Column) -> Column:
    """A statement's amount; null for a dash or nothing."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def dart_accounts(raw: DataFrame) -> DataFrame:
    """Accounts (company, pos, account_name, fs_div, current, previous) of statement files (company, json)."""
    rows = F.from_json("json", "list array<struct<account_nm:string,fs_div:string,thstrm_amount:string,frmtrm_amount:string>>")["list"]
    return raw.select("company", F.posexplode(rows).alias("pos", "r")).select("company", "pos", F.trim("r.account_nm").alias("account_name"), F.upper(F.trim("r.fs_div")).alias("fs_div"), amount(F.col("r.thstrm_amount")).alias("current"), amount(F.col("r.frmtrm_amount")).alias("previous"))


def select_accounts(accounts: DataFrame) -> DataFrame:
    """One row for each account: consolidated before separate statements before others, then the first."""
    rank = F.when(F.col("fs_div") == "CFS", 0).when(F.col("fs_div") == "OFS", 1).otherwise(2)
    return accounts.withColumn("n", F.row_number().over(Window.partitionBy("company", "account_name").orderBy(rank, "pos"))).where("n = 1").drop("n")


def dart_fundamentals(accounts: DataFrame, year: str, market_caps: DataFrame) -> DataFrame:
    """(company, source, period, ratios) of a year's statements; companies without any ratio go."""
    s = select_accounts(accounts.where(F.col("account_name").isin(list(ACCOUNTS.values()))))
    at = lambda item, c: F.max(F.when(F.col("account_name") == ACCOUNTS[item], F.col(c)))
    one = s.groupBy("company").agg(at("revenue", "current").alias("revenue"), at("revenue", "previous").alias("previous"), at("income", "current").alias("income"), at("equity", "current").alias("equity"))
    one = one.join(market_caps.select("company", finite(F.col("market_cap")).alias("cap")), "company", "left")
    return one.select("company", F.lit("DART").alias("source"), F.lit(f"{year}-12-31").alias("period"), *ratios(*[F.col(c) for c in ("revenue", "previous", "income", "equity", "cap")])).where(any_ratio())


def submissions(raw: DataFrame) -> DataFrame:
    """Filings (cik, pos, form, filed_at, period_of_report, accession, url) of submission files (cik, json), whose columns are parallel lists; the shortest counts."""
    names = ["form", "filingDate", "reportDate", "accessionNumber", "primaryDocument"]
    r = F.from_json("json", "filings struct<recent:struct<" + ",".join(f"{n}:array<string>" for n in names) + ">>")["filings"]["recent"]
    each = raw.select("cik", r.alias("r")).withColumn("k", F.least(*[F.size(F.col("r")[n]) for n in names])).where("k > 0")
    each = each.select("cik", F.posexplode(F.slice(F.arrays_zip(*[F.col("r")[n].alias(n) for n in names]), F.lit(1), F.col("k"))).alias("pos", "f"))
    plain = F.replace("f.accessionNumber", F.lit("-"), F.lit(""))
    tail = F.when(F.coalesce("f.primaryDocument", F.lit("")) != "", F.concat(F.lit("/"), "f.primaryDocument")).otherwise(F.lit(""))
    url = F.when(F.col("f.accessionNumber") != "", F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace(F.col("cik").cast("string"), "^0+(?=.)", ""), F.lit("/"), plain, tail)).otherwise(F.lit(""))
    return each.select("cik", "pos", "f.form", F.col("f.filingDate").alias("filed_at"), F.coalesce(F.nullif("f.reportDate", F.lit("")), "f.filingDate").alias("period_of_report"), F.col("f.accessionNumber").alias("accession"), url.alias("url"))


def regime(forms: Column) -> Column:
    """The reporting regime that a set of forms shows."""
    over = lambda names: F.arrays_overlap(F.coalesce(forms, F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    return F.when(over(DOMESTIC), REGIMES[0]).when(over(FOREIGN), REGIMES[1]).when(over(CURRENT), REGIMES[2]).otherwise(REGIMES[3])


def filer_profiles(filings: DataFrame, limit: int = 20) -> DataFrame:
    """Per cik its regime by the latest filings, that of the oldest, whether it changed, the latest annual filing, and forms by count (a map; most common first, ties by first use)."""
    f = filings.withColumn("back", F.count("*").over(Window.partitionBy("cik")) - F.col("pos"))
    one = f.groupBy("cik").agg(F.collect_set(F.when(F.col("pos") < limit, F.col("form"))).alias("new"), F.collect_set(F.when(F.col("back") <= limit, F.col("form"))).alias("old"), F.min_by(F.struct("form", "filed_at"), F.when(F.col("form").isin(ANNUAL), F.col("pos"))).alias("annual"))
    counts = filings.groupBy("cik", "form").agg(F.count("*").alias("n"), F.min("pos").alias("p")).groupBy("cik").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "p", "form", "n"))).alias("c"))
    one = one.join(counts, "cik").withColumns({"reporting_regime": regime(F.col("new")), "previous_regime": regime(F.col("old"))})
    return one.select("cik", "reporting_regime", "previous_regime", ((F.col("previous_regime") != REGIMES[3]) & (F.col("previous_regime") != F.col("reporting_regime"))).alias("regime_changed"), F.col("annual.form").alias("annual_form"), F.col("annual.filed_at").alias("annual_filed_at"), F.map_from_entries(F.transform("c", lambda x: F.struct(x["form"], x["n"]))).alias("form_counts"))


def non_us(state: Column) -> Column:
    """Whether a company is incorporated outside the United States; not so if unknown."""
    s = F.upper(F.trim(F.coalesce(state, F.lit(""))))
    return (s != "") & ~s.isin(STATES)


# What evidence says of a filer, and the names of statements and of the accounts that are shown.
UNKNOWN, ABROAD, NONE = "미상", "(미국 밖)", "없음"
NO_QUARTERS = " 이 양식은 분기 실적 공시 의무가 없어 10-Q 가 존재하지 않는다."
CHANGED = (" 과거에는 ", " 으로 보고했다. 보고 체계가 바뀐 구간은 회계기준(IFRS/US-GAAP)도 함께 바뀌었을 수 있다.")
ABROAD_DOMESTIC = " 미국 밖에서 설립된 법인이지만 미국 내국법인 양식으로 보고한다."
REPORTS = {"11011": "사업보고서", "11012": "반기보고서", "11013": "1분기보고서", "11014": "3분기보고서"}
SHOWN_ACCOUNTS = ["매출액", "영업이익", "당기순이익", "자산총계", "부채총계", "자본총계"]
RATIO_NAMES = {"revenue_growth_pct": ("매출성장률 ", "%"), "profit_margin_pct": ("순이익률 ", "%"), "trailing_pe": ("PER ", ""), "price_to_book": ("PBR ", "")}
EVIDENCE = ["id", "kind", "title", "source", "observed_at", "available_at", "summary", "url"]


def filer_identities(raw: DataFrame) -> DataFrame:
    """(cik, entity_name, exchanges, sic_description, state, fiscal_year_end, is_non_us) of submission files (cik, json)."""
    r = F.from_json("json", "name string, exchanges array<string>, sicDescription string, stateOfIncorporation string, fiscalYearEnd string")
    known = lambda c: F.coalesce(c, F.lit(""))
    one = raw.select("cik", r.alias("r"))
    return one.select("cik", known(F.col("r.name")).alias("entity_name"), F.array_compact(F.coalesce("r.exchanges", F.array().cast("array<string>"))).alias("exchanges"), known(F.col("r.sicDescription")).alias("sic_description"), F.upper(F.trim(known(F.col("r.stateOfIncorporation")))).alias("state"), known(F.col("r.fiscalYearEnd")).alias("fiscal_year_end"), non_us(F.col("r.stateOfIncorporation")).alias("is_non_us"))


def profile_evidence(profiles: DataFrame, filings: DataFrame, identities: DataFrame, available_at: str, limit: int = 5) -> DataFrame:
    """Evidence rows (cik and EVIDENCE) of filers (see filer_profiles, filer_identities): who reports and how, the mix of forms, and the latest filings.

    Profile and mix are dated by the report period of the latest annual filing, else of the latest filing, else by when they were looked up.
    """
    dated = filings.groupBy("cik").agg(F.min_by("period_of_report", F.when(F.col("form").isin(ANNUAL), F.col("pos"))).alias("annual"), F.min_by("period_of_report", "pos").alias("newest"))
    p = profiles.join(identities, "cik").join(dated, "cik", "left")
    name = F.col("entity_name")
    titled = lambda tail: F.concat(F.coalesce(F.nullif(name, F.lit("")), F.col("cik").cast("string")), F.lit(tail))
    or_unknown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN))
    foreign = F.col("reporting_regime").isin(REGIMES[1:3])
    text = F.concat(
        F.lit("CIK "), F.col("cik").cast("string"), F.lit("; 사명 "), name, F.lit("; 거래소 "), or_unknown(F.array_join("exchanges", ", ")), F.lit("; 업종 "), or_unknown(F.col("sic_description")), F.lit("; 설립지 "), or_unknown(F.col("state")),
        F.when(F.col("is_non_us"), ABROAD).otherwise(""), F.lit("; 결산월 "), or_unknown(F.col("fiscal_year_end")), F.lit("; 보고 양식 "), F.col("reporting_regime"), F.lit("."), F.when(foreign, NO_QUARTERS).otherwise(""),
        F.when(F.col("regime_changed"), F.concat(F.lit(CHANGED[0]), F.col("previous_regime"), F.lit(CHANGED[1]))).otherwise(""), F.when(F.col("is_non_us") & ~foreign, ABROAD_DOMESTIC).otherwise(""),
    )
    mix = F.array_join(F.transform(F.slice(F.map_entries("form_counts"), 1, 8), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"), F.lit("건"))), ", ")
    at, now, filer = F.coalesce("annual", "newest", F.lit(available_at)), F.lit(available_at), F.lit("SEC EDGAR")
    row = lambda id, title, summary: F.struct(F.lit(id).alias("id"), F.lit("filing").alias("kind"), title.alias("title"), filer.alias("source"), at.alias("observed_at"), now.alias("available_at"), summary.alias("summary"), F.lit("").alias("url"))
    both = F.array(row("sec:profile", titled(" SEC 발행사 프로필"), text), row("sec:filings-mix", titled(" 최근 공시 구성"), F.concat(F.lit("최근 공시 폼 분포: "), F.coalesce(F.nullif(mix, F.lit("")), F.lit(NONE)), F.lit("."))))
    said = F.concat("entity_name", F.lit(" 가 "), "filed_at", F.lit(" 에 제출한 "), "form", F.lit("."))
    each = filings.where(F.col("pos") < limit).join(identities.select("cik", "entity_name"), "cik")
    each = each.select("cik", F.concat(F.lit("sec:filing:"), "accession").alias("id"), F.lit("filing").alias("kind"), F.concat("form", F.lit(" ("), "period_of_report", F.lit(" 기준)")).alias("title"), filer.alias("source"), F.col("period_of_report").alias("observed_at"), F.col("filed_at").alias("available_at"), said.alias("summary"), "url")
    return p.select("cik", F.inline(both)).unionByName(each)


def financial_evidence(fundamentals: DataFrame, available_at: str, key: str = "cik") -> DataFrame:
    """An evidence row for each row of fundamentals: the ratios that are there, in words."""
    parts = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(name), F.format_string("%.1f", c), F.lit(unit))) for c, (name, unit) in RATIO_NAMES.items()]))
    return fundamentals.select(key, F.concat(F.lit("sec:annual-financials:"), "period").alias("id"), F.lit("financial").alias("kind"), F.concat(F.lit("SEC EDGAR "), "period", F.lit(" 연차 재무 팩터")).alias("title"), F.lit("SEC EDGAR").alias("source"), F.col("period").alias("observed_at"), F.lit(available_at).alias("available_at"), F.array_join(parts, "; ").alias("summary"), F.lit("").alias("url"))


def account_evidence(accounts: DataFrame, names: DataFrame, year: str, report: str, available_at: str) -> DataFrame:
    """An evidence row for each company (names: company, name) that has accounts: the main ones of a year's statement, in the order in which they are shown."""
    s = select_accounts(accounts)
    place = F.array_position(F.array(*map(F.lit, SHOWN_ACCOUNTS)), F.col("account_name"))
    shown = F.when((place > 0) & F.col("current").isNotNull(), F.struct(place.alias("n"), F.concat("account_name", F.lit("="), F.format_number("current", 0), F.lit("원")).alias("t")))
    one = s.groupBy("company").agg(F.sort_array(F.collect_list(shown)).alias("p"))  # as many as SHOWN_ACCOUNTS
    summary = F.coalesce(F.nullif(F.array_join(F.transform("p", lambda x: x["t"]), "; "), F.lit("")), F.lit("주요계정 값을 읽지 못함"))
    title = F.concat("name", F.lit(f" {year} {REPORTS.get(report, report)} 주요계정"))
    id = F.concat(F.lit("dart:accounts:"), F.col("company").cast("string"), F.lit(f":{year}:{report}"))
    return one.join(names, "company").select("company", id.alias("id"), F.lit("financial").alias("kind"), title.alias("title"), F.lit("DART").alias("source"), F.lit(f"{year}-12-31").alias("observed_at"), F.lit(available_at).alias("available_at"), summary.alias("summary"), F.lit("").alias("url"))


def evidence_as_of(evidence: DataFrame, runs: DataFrame, by: tuple[str, ...] = ("symbol", "kind")) -> DataFrame:
    """For each run (symbol, as_of) the latest observed evidence of each kind among what was available then.

    Evidence and runs stand in one table, in order of time within the symbol and kind; what a run sees is the running maximum so far. So each row is sorted once, and no run meets the evidence
    of its symbol one by one. A run stands once for each kind that its symbol has evidence of; ties of time come before the run.
    """
    symbol, *kinds = by
    seen = evidence.select(*by, F.col("available_at").alias("_at"), F.struct("observed_at", "available_at", "id").alias("_e"), F.lit(None).cast(runs.schema["as_of"].dataType).alias("as_of"))
    asked = runs.select(symbol, "as_of").where("as_of is not null").distinct().select(symbol, *[F.lit(None).cast(evidence.schema[k].dataType).alias(k) for k in kinds], F.col("as_of").cast(evidence.schema["available_at"].dataType).alias("_at"), F.lit(None).cast(seen.schema["_e"].dataType).alias("_e"), "as_of")
    rows = seen.where("_at is not null").unionByName(asked)
    some = F.struct(*kinds) if kinds else F.struct(F.lit(0).alias("_all"))
    rows = rows.withColumn("_kinds", F.collect_set(F.when(F.col("_e").isNotNull(), some)).over(Window.partitionBy(symbol)))  # as many as there are kinds
    rows = rows.withColumn("_kind", F.explode(F.when(F.col("_e").isNull(), F.col("_kinds")).otherwise(F.array(some)))).drop("_kinds", *kinds)
    order = [F.col("_at"), F.col("_e").isNull()]
    best = F.max("_e").over(Window.partitionBy(symbol, "_kind").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_best", best).where(F.col("as_of").isNotNull() & F.col("_best").isNotNull())
    return rows.select("as_of", symbol, *[F.col(f"_kind.{k}").alias(k) for k in kinds], F.col("_best.id").alias("id"), F.col("_best.observed_at").alias("observed_at"))
