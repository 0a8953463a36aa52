"""Filings, companies, valuation, stock news and providers with known values."""

import json
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import companies, filings, news, stock_news, valuation
from tidemark.sources import tables


def facts(revenue, income, equity):
    """A company's facts file."""
    row = lambda end, val, filed="2025-02-01": {"form": "10-K", "end": end, "filed": filed, "val": val}
    unit = lambda rows: {"units": {"USD": rows}}
    return json.dumps({"facts": {"us-gaap": {"Revenues": unit([row("2024-12-31", revenue[0]), row("2023-12-31", revenue[1]), row("2023-12-31", 1.0, "2024-01-01")]), "NetIncomeLoss": unit([row("2024-12-31", income)]), "StockholdersEquity": unit([row("2024-12-31", equity)])}}})


def test_sec_fundamentals(spark):
    raw = spark.createDataFrame([(1, facts((2000, 1600), 200, 1000)), (2, facts((2000, 1600), -5, -1))], "cik long, json string")
    caps = spark.createDataFrame([(1, 4000.0), (2, 4000.0)], "cik long, market_cap double")
    got = {r.cik: r for r in filings.sec_fundamentals(filings.sec_facts(raw), caps).collect()}
    assert (got[1].revenue_growth_pct, got[1].profit_margin_pct, got[1].trailing_pe, got[1].price_to_book) == pytest.approx((25, 10, 20, 4))
    assert got[2].trailing_pe is None and got[2].price_to_book is None and got[1].period == "2024-12-31"


def test_dart_fundamentals(spark):
    row = lambda name, div, now, then="-": {"account_nm": name, "fs_div": div, "thstrm_amount": now, "frmtrm_amount": then}
    raw = spark.createDataFrame([("c", json.dumps({"list": [row("매출액", "OFS", "1"), row("매출액", "CFS", "2,000", "1,600"), row("당기순이익", "CFS", "200"), row("자본총계", "CFS", "1,000")]}))], "company string, json string")
    caps = spark.createDataFrame([("c", 4000.0)], "company string, market_cap double")
    r = filings.dart_fundamentals(filings.dart_accounts(raw), "2024", caps).first()
    assert (r.revenue_growth_pct, r.profit_margin_pct, r.trailing_pe, r.price_to_book, r.period) == pytest.approx((25, 10, 20, 4, "2024-12-31")) or r.period == "2024-12-31"


def test_profiles(spark):
    def recent(forms):
        n = len(forms)
        return json.dumps({"filings": {"recent": {"form": forms, "filingDate": ["2025-01-01"] * n, "reportDate": [""] * n, "accessionNumber": ["0001-25-1"] * n, "primaryDocument": ["a.htm"] * (n + 1)}}})

    raw = spark.createDataFrame([("0000000012", recent(["6-K", "6-K", "6-K", "8-K"])), ("0000000013", recent(["10-K", "10-Q", "20-F", "6-K"]))], "cik string, json string")
    f = filings.submissions(raw)
    assert f.first().url == "https://www.sec.gov/Archives/edgar/data/12/0001251/a.htm"
    got = {r.cik: r for r in filings.filer_profiles(f, 2).collect()}
    assert got["0000000012"].form_counts == {"6-K": 3, "8-K": 1} and got["0000000012"].reporting_regime == filings.REGIMES[2]
    assert got["0000000013"].regime_changed and got["0000000013"].annual_form == "10-K"


def test_resolution(spark):
    c = spark.createDataFrame([("0000320193", "AAPL", "Apple Inc.", ["AAPL-A"]), ("0001045810", "NVDA", "NVIDIA CORP", []), ("0000000001", "CODA", "Coda Holdings Corp", []), ("0000000002", "X", "Same", []), ("0000000003", "Y", "Same, Ltd.", [])], "key string, ticker string, name string, aliases array<string>")
    alias = spark.createDataFrame([("엔비디아", "NVDA")], "alias string, ticker string")
    q = spark.createDataFrame([(x,) for x in ("aapl", "AAPL.A", "0001045810", "엔비디아", "apple", "coda", "same", "nvid", "zzz", " ")], "query string")
    got = {r.query: (r.key, r.error) for r in companies.resolve_companies(q, c, alias).collect()}
    assert got["aapl"][0] == got["AAPL.A"][0] == got["apple"][0] == "0000320193" and got["0001045810"][0] == got["엔비디아"][0] == got["nvid"][0] == "0001045810"
    assert got["coda"][0] == "0000000001" and got["same"] == (None, "ambiguous") and got["zzz"] == (None, "unknown") and got[" "] == (None, "empty")
    names = {r.name_key: list(r["keys"]) for r in companies.name_map(c).collect()}
    assert names["SAME"] == ["0000000002", "0000000003"] and "CODA" in names and "NVIDIA" in names


def test_tickers_file(spark):
    rows = {str(i): {"cik_str": 1000 + i // 2, "ticker": f"t{i}", "title": f"Name {i}"} for i in range(10)}
    raw = spark.createDataFrame([(json.dumps(rows),)], "json string")
    got = {r.key: r for r in companies.company_tickers(raw, 5).collect()}
    assert len(got) == 5 and got["0000001000"].ticker == "T0" and got["0000001000"].aliases == ["T1"]
    with pytest.raises(Exception, match="too few"):
        companies.company_tickers(raw, 1000).collect()


def test_valuation(spark):
    names = [*valuation.RAW, "symbol"]
    x = spark.createDataFrame([(100.0, 5.0, 40.0, 200.0, 50.0, 100.0, 10.0, "a"), (100.0, -5.0, -1.0, 200.0, 50.0, 100.0, 10.0, "b"), (100.0, 5.0, 40.0, 200.0, 50.0, 100.0, 10.0, "c")], names)
    a = spark.createDataFrame([("a", 20.0, 3.0, 6.0, 100.0, 0.0, 10.0, 0.0), ("b", 20.0, 3.0, None, None, None, None, None), ("c", 0.0, None, None, None, None, None, None)], "symbol string, " + ", ".join(f"{c} double" for c in valuation.ASSUMED))
    got = {(r.symbol, r.method): r for r in valuation.valuation(x, a).collect()}
    assert [got["a", m].value for m in ("pe", "pb", "ev_ebitda", "dcf")] == pytest.approx([100, 120, 115, 95])
    assert got["b", "pe"].value is None and got["b", "pe"].reason and got["c", "pe"].error == "invalid target_pe"


def test_stock_news(spark):
    t = datetime(2026, 8, 1)
    rows = [("ARM", "Naver", 1, "an arm injury", "", "https://a/1", t, None), ("ARM", "Naver", 2, "NASDAQ:ARM rises", "", "https://a/2?utm_source=x", t, None), ("ARM", "DB", 3, "NASDAQ:ARM rises", "", "https://a/2", t, 80.0), ("ARM", "Naver", 4, "Arm Holdings, up!", "", "", t, None), ("ARM", "GDELT", 5, "arm holdings up", "", "", t, None)]
    items = spark.createDataFrame(rows, "symbol string, provider string, seq int, title string, summary string, url string, observed_at timestamp, score double")
    q = spark.createDataFrame([("ARM", ["ARM", "Arm Holdings"], datetime(2026, 7, 20), datetime(2026, 8, 2))], "symbol string, terms array<string>, since timestamp, until timestamp")
    chosen, counts = stock_news.select_stock_news(items, q)
    assert sorted((r.provider, r.title) for r in chosen.collect()) == [("DB", "NASDAQ:ARM rises"), ("Naver", "Arm Holdings, up!")]
    assert {r.provider: (r.fetched, r.accepted) for r in counts.collect()} == {"Naver": (3, 1), "DB": (1, 1), "GDELT": (1, 0)}


def test_cooldowns(spark):
    at = datetime(2026, 1, 1, 3)
    rows = [(429, '429 quota "retryDelay": "27s"', at), (429, "429 too many", at), (429, "429 PerDay limit", datetime(2026, 1, 1, 13)), (402, "x", datetime(2026, 1, 1, 14, 40)), (401, "", at), (503, "", at), (404, "", at)]
    df = spark.createDataFrame(rows, "status int, detail string, ts timestamp")
    kind = stock_news.classify_failure(F.col("status"), F.col("detail"))
    got = [str(r.u) for r in df.select(F.date_format(stock_news.cooldown_until(kind, F.col("detail"), F.col("ts")), "MM-dd HH:mm:ss").alias("u")).collect()]
    assert got == ["01-01 03:00:27", "01-01 03:01:00", "01-01 15:00:00", "01-01 15:00:00", "01-01 09:00:00", "01-01 03:05:00", "01-01 03:30:00"]


def test_relevance_of_terms(spark):
    rows = [(1, "X", "S-Oil up", ""), (2, "X", "a.S-OIL.b", ""), (3, "X", "XS-Oil", "S-Oils"), (4, "X", "", "보고서: 에쓰오일은"), (5, "X", "Johnson & Johnson", ""), (6, "X", "Johnson&Johnson JYP Ent.", ""), (7, "X", "JYP Ent.x", "x"), (8, "X", None, None), (9, "ON", "on the day", "$ON rises"), (10, "ON", "turn on", "NYSE: ON2"), (11, "ON", "NASDAQ:on", ""), (12, "ON", "$ON한", "on"), (13, "none", "x", "x")]
    items = spark.createDataFrame(rows, "id int, symbol string, title string, summary string")
    q = spark.createDataFrame([("X", ["S-Oil", "에쓰오일", "Johnson & Johnson", "JYP Ent."]), ("ON", ["ON"])], "symbol string, terms array<string>")
    got = {x.id: x.relevance for x in stock_news.news_relevance(items, q).collect()}
    assert got == {1: 2, 2: 2, 3: 0, 4: 1, 5: 2, 6: 2, 7: 0, 8: 0, 9: 2, 10: 0, 11: 2, 12: 0}


def test_another_companys_name_is_not_relevant(spark):
    now = datetime(2026, 8, 2)
    q = stock_news.stock_queries(spark.createDataFrame([("035720.KS", "카카오", now), ("arm", "Arm plc", now)], "symbol string, company string, now timestamp"))
    terms = {x.symbol: x.terms for x in q.collect()}
    assert terms == {"035720": ["카카오", "035720"], "ARM": ["Arm plc", "Arm Holdings", "ARM홀딩스", "ARM"]}
    items = spark.createDataFrame([(1, "035720", "카카오뱅크 실적", ""), (2, "035720", "카카오와 카카오뱅크", ""), (3, "ARM", "Arm Holdings", "")], "article_id int, symbol string, title string, summary string")
    matched = news.match_symbols(items.withColumnRenamed("summary", "body")).withColumnRenamed("body", "summary")
    assert {x.article_id: x.relevance for x in stock_news.news_relevance(matched, q).collect()} == {1: 0, 2: 2, 3: 2}


def test_evidence_as_of_against_loops(spark, capsys):
    r = random.Random(8)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    e = [(r.choice("ABC"), r.choice(["x", "y", None]), day(r.randint(0, 40)), day(r.randint(0, 40)) if r.random() < 0.95 else None, i) for i in range(300)]
    runs = [(r.choice("ABCD"), day(r.randint(-3, 45))) for _ in range(60)] + [("A", None), ("B", day(10)), ("B", day(10))]
    found = filings.evidence_as_of(spark.createDataFrame(e, "symbol string, kind string, observed_at timestamp, available_at timestamp, id long"), spark.createDataFrame(runs, "symbol string, as_of timestamp"))
    want = {}
    for s, t in runs:
        for symbol, kind, seen, at, i in e:
            if t is not None and at is not None and symbol == s and at <= t:
                want[s, t, kind] = max(want.get((s, t, kind), (datetime(1970, 1, 1), at, -1)), (seen, at, i))
    assert {(x.symbol, x.as_of, x.kind): x.id for x in found.collect()} == {k: v[2] for k, v in want.items()}
    found.explain()
    assert "Join" not in capsys.readouterr().out


def test_lists_are_read_in_splits_and_zips_by_pieces(spark, tmp_path, monkeypatch):
    n = 20_000
    body = "<result>" + "".join(f"<list><corp_code>{i:08d}</corp_code><corp_name>회사 {i}</corp_name><stock_code>{i if i % 2 else ' '}</stock_code><modify_date>20240101</modify_date></list>\n" for i in range(n)) + "</result>"
    plain = tmp_path / "list.xml"
    plain.write_text(body, encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "list.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.write(plain, "CORPCODE.xml")
        z.writestr("other.txt", "<list><corp_code>no</corp_code><stock_code>1</stock_code></list>")
    want = {(f"{i:08d}", str(i), f"회사 {i}") for i in range(n) if i % 2}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        records = companies.read_records(spark, str(plain), "</list>")
        assert records.rdd.getNumPartitions() > 5
        assert {(r.key, r.ticker, r.name) for r in companies.corp_codes(records).collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    files = spark.read.format("binaryFile").load(str(tmp_path / "list.zip")).select("path", "content")
    for size in (1000, 1 << 20):
        monkeypatch.setattr(companies, "CHUNK", size)
        assert {(r.key, r.ticker, r.name) for r in companies.corp_codes(companies.zipped_records(files, "</list>", member=".xml")).collect()} == want
    korean = tmp_path / "master.txt"
    korean.write_bytes("한글 줄\r\n둘째".encode("cp949"))
    assert [r.record for r in companies.read_records(spark, str(korean), "\n", "cp949").collect()] == ["한글 줄\r", "둘째"]


def test_tables_are_read_from_a_database_in_parts(spark, tmp_path):
    """Derby, which comes with Spark: rows are read by ranges of the key, filters go to the database, lists are JSON text there."""
    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, f"summary {i}", f'["k{i}", "x"]' if i % 3 else None, t + timedelta(hours=i)) for i in range(40)], "article_id long, summary string, keywords string, created_at timestamp")
    rows.write.format("jdbc").options(url=url, dbtable="insights", **options).save()
    read = tables.read_jdbc(spark, "insights", url, "insights", "article_id", 0, 40, 4, **options)
    assert read.columns == spark.createDataFrame([], tables.SCHEMAS["insights"]).columns and read.rdd.getNumPartitions() == 4
    got = {r.article_id: r for r in read.collect()}
    assert len(got) == 40 and got[4].keywords == ["k4", "x"] and got[3].keywords is None and got[5].created_at == t + timedelta(hours=5) and got[5].engine is None
    assert [r.summary for r in read.where("article_id = 7").collect()] == ["summary 7"]


def test_what_is_exploded_from_a_small_file_is_not_broadcast(spark, tmp_path):
    """Beginnings of tickers and grams of names come from a file that Spark may broadcast by its size."""
    spark.range(1, 3000).selectExpr("cast(id as string) AS key", "concat('S', id) AS ticker", "concat('name ', id) AS name").write.parquet(str(tmp_path / "c"))
    c = spark.read.parquet(str(tmp_path / "c"))
    df = companies.autocomplete(spark.createDataFrame([("s12",), ("name 12",), (" ",)], "query string"), c, 3)
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    sent = [below for line, below in zip(plan, plan[1:]) if "BroadcastExchange" in line]
    assert sent and not [x for x in sent if "ticker" in x or "name#" in x]
    found = {(r["query"], r["rank"]): r["key"] for r in df.collect()}
    assert found == {("s12", 1): "12", ("s12", 2): "120", ("s12", 3): "121", ("name 12", 1): "12", ("name 12", 2): "120", ("name 12", 3): "121"}
