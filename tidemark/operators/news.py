"""Reading articles: rule-based insight, keywords, mentioned symbols, merging of model replies."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.aliases import Entry, Matcher
from tidemark.functions.numbers import clamp, half_up
from tidemark.functions.symbols import NOISE, companies
from tidemark.functions.text import MATERIAL, NEGATIVE, POSITIVE, STOPWORDS, analyze_news, counted, keyword, strip_particle

# What a model may say.
SENTIMENTS = ["긍정", "부정", "중립"]
MATERIALITIES = ["높음", "보통", "낮음"]
HORIZONS = ["당일", "단기(1~4주)", "중기(1~2분기)", "장기(1년+)"]
MATCH = "array<struct<symbol:string,company:string,market:string,sector:string,mentions:int,relevance:int>>"


def analyzed(df: DataFrame, text: Column, symbol: Column | None = None, company: Column | None = None, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, material: list[str] = MATERIAL) -> DataFrame:
    """df with the rule-based reading of a text as further columns."""
    keep = [c for c in df.columns]
    for layer in counted(text, positive, negative, material):
        df = df.withColumns(layer)
    found = analyze_news(text, F.lit("MARKET") if symbol is None else symbol, F.lit("시장 전체") if company is None else company)
    return df.select(*[c for c in keep if c not in found], *[c.alias(n) for n, c in found.items()])


def tokens(text: Column) -> Column:
    """Tokens of a text of two characters or more, without particles."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), "[^0-9A-Za-z가-힣%]+", -1), lambda t: F.length(t) >= 2), lambda t: strip_particle(t))


def keywords(articles: DataFrame, limit: int = 8, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """(article_id, keywords): tokens by weight (four in the title, one in the body, more than one in all), ties by token.

    A token that stands once in the body and not in the title can't be one, so of a text's tokens in order only repeats and those of the title leave their row; what a keyword may be is asked of
    each token of an article once.
    """
    rows = articles.select("article_id", tokens(F.col("title")).alias("named"), F.sort_array(tokens(F.col("body"))).alias("told"))
    near = lambda i: F.get("told", i)
    told = F.filter("told", lambda t, i: F.coalesce(near(i - 1) == t, F.lit(False)) | F.coalesce(near(i + 1) == t, F.lit(False)) | F.array_contains("named", t))
    weighed = lambda xs, w: F.transform(xs, lambda t: F.struct(t.alias("token"), F.lit(w).alias("w")))
    each = rows.select("article_id", F.inline(F.concat(weighed(F.col("named"), 4), weighed(told, 1)))).groupBy("article_id", "token").agg(F.sum("w").alias("w"))
    each = each.where(F.col("w") > 1).where(keyword(F.col("token"), stopwords))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("m"), "token"))), 1, limit)
    top = each.groupBy("article_id").agg(best.alias("k"))
    return articles.select("article_id").join(top.select("article_id", F.transform("k", lambda x: x["token"]).alias("keywords")), "article_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def match_symbols(articles: DataFrame, dictionary: Iterable[tuple] | None = None, noise: Iterable[str] | None = None, limit: int = 8) -> DataFrame:
    """articles with matches: the symbols that title and body mention, best first.

    dictionary: (symbol, name, market, sector, aliases), of bounded size; without one, the default dictionary and its noise. An automaton of all aliases is built once a task; it
    reads each text once, however many aliases there are (see Matcher). Null texts are empty.
    """
    noise = list(noise if noise is not None else NOISE if dictionary is None else ())
    dictionary = [Entry(*e[:4], tuple(e[4])) for e in (companies() if dictionary is None else dictionary)]

    kind = pa.list_(pa.struct([*[(c, pa.string()) for c in ("symbol", "company", "market", "sector")], ("mentions", pa.int32()), ("relevance", pa.int32())]))

    @F.arrow_udf(MATCH)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        matcher = Matcher(dictionary, noise)
        for titles, bodies in batches:  # one text at a time leaves Arrow
            yield pa.array((matcher.matches(t.as_py() or "", b.as_py() or "", limit) for t, b in zip(titles, bodies, strict=True)), kind)

    return articles.withColumn("matches", run("title", "body"))


def article_symbols(matched: DataFrame) -> DataFrame:
    """A row per article and symbol."""
    return matched.select("article_id", F.inline("matches"))


def symbol_table(spark: SparkSession, dictionary: Iterable[tuple] | None = None) -> DataFrame:
    """The dictionary (the default one, if none is given) as a table, pos being the order of its lines."""
    rows = [(i, *e[:4], list(e[4])) for i, e in enumerate(companies() if dictionary is None else dictionary)]
    return spark.createDataFrame(rows, "pos int, symbol string, name string, market string, sector string, aliases array<string>")


def lookup_symbol(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query, symbol): the first entry (by pos) whose symbol, name or alias a query is, without case."""
    names = dictionary.select("pos", "symbol", F.explode(F.concat(F.array("symbol", "name"), "aliases")).alias("n"))
    names = names.groupBy(F.lower("n").alias("k")).agg(F.min_by("symbol", "pos").alias("symbol"))
    return queries.withColumn("k", F.lower(F.trim("query"))).join(names, "k", "left").select("query", "symbol")


def rule_insight(matched: DataFrame, words: DataFrame, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, material: list[str] = MATERIAL) -> DataFrame:
    """An insight for each article (with matches): summary of its first long lines, keywords, sectors, evidence and the rule-based reading of its first 8000 characters."""
    long = F.slice(F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 30), 1, 2)
    sectors = F.slice(F.array_distinct(F.transform("matches", lambda m: m["sector"])), 1, 4)
    base = matched.join(words, "article_id", "left")
    text = F.substring(F.concat("title", F.lit(". "), "body"), 1, 8000)
    base = analyzed(base, text, positive=positive, negative=negative, material=material)
    lead = F.when(F.size(long) > 0, F.array_join(long, " ")).when(F.col("body") != "", F.col("body")).otherwise(F.col("title"))
    view = F.when(F.size(sectors) > 0, F.concat(F.array_join(sectors, ", "), F.lit(" 업종에 관련된 보도입니다."))).otherwise("특정 업종을 지목하기 어려운 일반 보도입니다.")
    return base.select("article_id", F.substring(lead, 1, 400).alias("summary"), "keywords", sectors.alias("sectors"), "evidence", "sentiment", half_up(F.col("sentiment_score")).cast("int").alias("sentiment_score"), "materiality", "event_type", "impact_horizon", view.alias("market_view"), "score_adjustment", F.lit("규칙 기반").alias("engine"), F.lit("").alias("model"), F.size("matches").alias("n_symbols"))


def apply_insight(articles: DataFrame, insights: DataFrame, matched: DataFrame) -> DataFrame:
    """Articles with what their insight says: sentiment, materiality, event, the best symbol (GENERAL if none) and its relevance (40), done."""
    names = ["sentiment", "sentiment_score", "materiality", "event_type", "score_adjustment"]
    i = insights.select("article_id", F.struct(*names, F.substring("summary", 1, 500).alias("analysis_summary")).alias("i"))
    m = matched.select("article_id", F.get("matches", F.lit(0)).alias("m"))
    out = articles.join(i, "article_id", "left").join(m, "article_id", "left")
    done = F.col("i").isNotNull()
    ours = {n: F.col("i").getField(n) for n in [*names, "analysis_summary"]} | {"symbol": F.coalesce("m.symbol", F.lit("GENERAL")), "relevance": F.coalesce("m.relevance", F.lit(40)), "insight_status": F.lit("완료")}
    put = [(F.when(done, c).otherwise(F.col(n)) if n in articles.columns else F.when(done, c)).alias(n) for n, c in ours.items()]
    return out.select(*[c for c in articles.columns if c not in ours], *put)


def choose_body(body: Column, excerpt: Column) -> Column:
    """The fetched body where it is longer than the stored excerpt."""
    return F.when(F.length(body) > F.length(excerpt), body).otherwise(excerpt)


def extract_json(reply: Column) -> Column:
    """What stands from a reply's first brace to its last; null without."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


def string_list(v: Column, limit: int, length: int) -> Column:
    """Strings of a list, trimmed and cut, without empty ones."""
    cut = F.filter(F.transform(v, lambda x: F.substring(F.trim(x), 1, length)), lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.coalesce(cut, F.array().cast("array<string>")), 1, limit)


def merge_llm_insight(base: DataFrame, replies: DataFrame) -> DataFrame:
    """base (insights) with a model's replies (article_id, reply, engine, model): each field is taken if it is valid, else the rules' stays."""
    text, number = "string", "string"  # numbers may come as text
    schema = f"summary {text}, keywords array<string>, sectors array<string>, evidence array<string>, sentiment {text}, sentimentScore {number}, materiality {text}, eventType {text}, impactHorizon {text}, marketView {text}, scoreAdjustment {number}"
    r = replies.select("article_id", F.from_json(extract_json(F.col("reply")), schema).alias("r"), F.col("engine").alias("_engine"), F.col("model").alias("_model"))
    out = base.join(r, "article_id", "left").withColumn("r", F.when(F.to_json("r") != "{}", F.col("r")))
    said = F.col("r").isNotNull()
    whole = lambda f, lo, hi: half_up(clamp(F.nanvl(F.col(f"r.{f}").try_cast("double"), F.lit(None).cast("double")), lo, hi)).cast("int")
    lists = lambda f, n, k: F.when(F.size(string_list(F.col(f"r.{f}"), n, k)) > 0, string_list(F.col(f"r.{f}"), n, k)).otherwise(F.col(f))
    pick = lambda f, c, allowed: F.when(F.col(f"r.{f}").isin(allowed), F.col(f"r.{f}")).otherwise(F.col(c))
    kind = F.nullif(F.trim("r.eventType"), F.lit(""))
    new = {
        "summary": F.substring(F.trim(F.coalesce("r.summary", "summary")), 1, 800),
        "keywords": lists("keywords", 8, 30),
        "sectors": lists("sectors", 4, 30),
        "evidence": lists("evidence", 3, 200),
        "sentiment": pick("sentiment", "sentiment", SENTIMENTS),
        "sentiment_score": F.coalesce(whole("sentimentScore", 0, 100), "sentiment_score"),
        "materiality": pick("materiality", "materiality", MATERIALITIES),
        "event_type": F.coalesce(F.substring(kind, 1, 40), "event_type"),
        "impact_horizon": pick("impactHorizon", "impact_horizon", HORIZONS),
        "market_view": F.substring(F.trim(F.coalesce("r.marketView", "market_view")), 1, 400),
        "score_adjustment": F.coalesce(whole("scoreAdjustment", -8, 8), "score_adjustment"),
        "engine": F.col("_engine"),
        "model": F.col("_model"),
    }
    return out.select(*[F.when(said, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in base.columns])


def merge_report(quant: DataFrame, replies: DataFrame, evidence: DataFrame) -> DataFrame:
    """quant (symbol, numbers) with a model's narrative (symbol, reply): lists are capped, the stance is one of three, cited ids must be known; numbers stay the quantitative side's."""
    schema = "stance string, summary string, strengths array<string>, risks array<string>, evidence_ids array<string>"
    r = replies.select("symbol", F.from_json(extract_json(F.col("reply")), schema).alias("r"))
    known = evidence.groupBy("symbol").agg(F.array_sort(F.collect_set("id")).alias("known"))
    out = quant.join(r, "symbol", "left").join(known, "symbol", "left")
    ids = F.slice(F.array_intersect(F.coalesce("r.evidence_ids", F.array().cast("array<string>")), F.coalesce("known", F.array().cast("array<string>"))), 1, 10)
    stance = F.when(F.col("r.stance").isin("긍정", "중립", "부정"), F.col("r.stance")).otherwise("중립")
    return out.select(*quant.columns, stance.alias("stance"), F.coalesce(F.substring(F.trim("r.summary"), 1, 1000), F.lit("")).alias("narrative"), string_list(F.col("r.strengths"), 5, 300).alias("strengths"), string_list(F.col("r.risks"), 5, 300).alias("risks"), ids.alias("evidence_ids"))


def retry_outcomes(articles: DataFrame, failed: DataFrame, most: int = 3) -> DataFrame:
    """Articles whose analysis failed go back to waiting with one attempt more, and are given up at the third."""
    f = failed.select("article_id", F.lit(True).alias("_failed")).distinct()
    out = articles.join(f, "article_id", "left").withColumn("attempts", F.col("attempts") + F.col("_failed").isNotNull().cast("int"))
    state = F.when(F.col("_failed").isNotNull(), F.when(F.col("attempts") >= most, "오류").otherwise("대기")).otherwise(F.col("insight_status"))
    return out.withColumn("insight_status", state).drop("_failed")


def evidence_fingerprint(snapshot: DataFrame, evidence: DataFrame) -> DataFrame:
    """(symbol, digest): what tells whether a report would say the same: day, price to four digits, period and evidence."""
    ids = evidence.groupBy("symbol").agg(F.sort_array(F.collect_set(F.concat_ws("|", "id", F.coalesce("summary", F.lit(""))))).alias("ids"))
    s = snapshot.join(ids, "symbol", "left")
    content = F.to_json(F.struct("symbol", F.col("observed_at").cast("string").alias("day"), F.format_string("%.3e", "price").alias("price"), F.coalesce("financial_period", F.lit("")).alias("period"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids")))
    return s.select("symbol", F.sha2(content, 256).alias("digest"))


def reuse(requests: DataFrame, reports: DataFrame, now: datetime, minutes: int = 20) -> DataFrame:
    """Requests (symbol, digest) with report_id where a successful report of the same digest is young enough."""
    young = reports.where("ok").where(F.col("created_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))
    last = young.groupBy("digest").agg(F.max_by("report_id", "created_at").alias("report_id"))
    return requests.join(last, "digest", "left")
