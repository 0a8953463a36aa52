"""Text, URLs, dates, feeds and insights with known values."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text, urls
from tidemark.operators import archive, news, search
from tidemark.sources import feeds

AT = datetime(2026, 8, 27, 12)
DICTIONARY = [("323410", "카카오뱅크", "KR", "은행", ["카카오뱅크"]), ("035720", "카카오", "KR", "인터넷", ["카카오"]), ("ARM", "Arm", "US", "반도체", ["ARM", "Arm Holdings"])]


def now():
    """The time at which all is read."""
    return F.lit(AT).cast("timestamp")


def column(spark, values, make):
    """make(column) over strings."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_visible_dates(spark):
    none = ["경기 결과 3-2 완승", "기사 번호 AKR20260827173200001", "조회수 1,234", "1-0", "부산 2-1 승리", "12", "12-3", "2026", "댓글 5", "", "２０２６-０８-２７ １０:００"]
    assert column(spark, none, lambda c: dates.parse_visible_date(c, now())) == [None] * len(none)
    some = {"2026-02-30 10:00": datetime(2026, 3, 2, 1), "3분 전": datetime(2026, 8, 27, 11, 57), "오늘 09:10": datetime(2026, 8, 27, 0, 10), "08-27 18:18": datetime(2026, 8, 27, 9, 18), "12-31 10:00": datetime(2025, 12, 31, 1), "8월 27일 9시": datetime(2026, 8, 27), "Thu, 27 Aug 2026 18:18:07 +0900": datetime(2026, 8, 27, 9, 18, 7)}
    assert column(spark, some, lambda c: F.date_format(dates.parse_visible_date(c, now()), "yyyy-MM-dd HH:mm:ss")) == [str(v) for v in some.values()]


def test_urls(spark):
    base = F.lit("https://news.example.com/news")
    want = {"/v/1?utm_source=a&keep=1": "https://news.example.com/v/1?keep=1", "/v/1?section=x&cp=y&ref=z": "https://news.example.com/v/1", "/v/1?": "https://news.example.com/v/1?", "/v/1?utm_source=a": "https://news.example.com/v/1", "https://X.com:443/a/../b?q=1#z": "https://x.com/b?q=1", "https://x.com/a?page=2&ref=x": "https://x.com/a?page=2", "javascript:void(0)": "javascript:void(0)"}
    assert column(spark, want, lambda c: urls.canonical_url(c, base)) == list(want.values())
    plain = ["http://a.com", "https://a.com:443/x?utm_a=1&b=2#f", "http://a-b.co.kr:8080/x/y?ref=1", "https://a.com/?sid=1&REF=2&x="]
    assert column(spark, plain, lambda c: urls.simple(c, True)) == [urls.resolve(u, "", True) for u in plain]
    hosts = {"172.16.0.1": True, "172.15.0.1": False, "999.1.1.1": True, "1.1.1.1": False, "10.0.0.1": True, "a.b": False}
    assert column(spark, hosts, urls.private_host) == list(hosts.values())
    errors = {"file:///etc/passwd": "HTTP", "https://localhost/a": "내부", "http://u:p@a.com": "내부", "abc": "올바른", "http://0x7f000001/": "내부", "https://a.com/x": None}
    got = column(spark, errors, lambda c: urls.validate_source_url(c)["error"])
    assert all((g is None) == (w is None) and (w is None or g.startswith(w)) for g, w in zip(got, errors.values(), strict=True))


def test_schedule(spark):
    at = lambda t, m: spark.range(1).select(dates.next_interval_run_at(F.lit(m), F.lit(t).cast("timestamp")).alias("x")).first().x
    assert [at(datetime(2026, 1, 1, 12, m, s), 30) for m, s in ((5, 0), (29, 59), (30, 0), (44, 0))] == [datetime(2026, 1, 1, 12, 30), datetime(2026, 1, 1, 12, 30), datetime(2026, 1, 1, 13), datetime(2026, 1, 1, 13)]
    got = spark.createDataFrame([(1.0,), (99999.0,), (0.0,), (None,), (float("nan"),)], "m double").select(dates.clamp_interval(F.col("m")).alias("x")).collect()
    assert [r.x for r in got] == [5, 1440, 0, 0, 0]


def test_recency_bounds(spark):
    rows = [(1, datetime(2026, 1, 1, 0)), (2, datetime(2025, 12, 31, 23, 59, 59)), (3, datetime(2026, 1, 2, 14)), (4, datetime(2026, 1, 2, 14, 0, 1)), (5, None)]
    items = spark.createDataFrame(rows, "id int, published_at timestamp")
    assert {r.id for r in archive.select_recent(items, datetime(2026, 1, 2, 12)).collect()} == {1, 3}


def test_text(spark):
    assert column(spark, ["&amp;lt; &#44032;&#xB098; &euro;&nbsp;<b>y</b><script>z</script><![CDATA[<i>q</i>]]>"], text.clean_text) == ["&lt; 가나 &euro; y q"]
    assert column(spark, ["&euro;x&#44032;"], text.plain) == ["x가"]
    page = "<p>" + "첫 문단은 충분히 길어서 본문으로 남는다. " * 2 + "</p><p>" + "둘째 문단도 충분히 길어서 본문으로 남는다. " * 2 + "</p><p>무단 전재 및 재배포 금지라는 문구가 있는 긴 문단</p><script>x</script>"
    (body,) = column(spark, [page], text.extract_body)
    assert body.count("\n") == 1 and "무단" not in body
    assert column(spark, ["<div><p>짧음</p><p>이것도짧다</p></div>"], text.extract_body) == ["짧음 이것도짧다"]
    assert column(spark, ["an alarm went off", "ARM shares rose, arm"], lambda c: text.occurrences(c, "ARM")) == [0, 2]
    df = spark.createDataFrame([(1, "삼성전자 실적이 성장했다. 매출과 영업이익이 크게 개선되었다는 소식이 전해졌습니다. guidance raised")], "id int, t string")
    r = news.analyzed(df, F.col("t")).first()
    assert (r.sentiment, r.materiality, r.event_type, r.impact_horizon) == ("긍정", "높음", "실적·가이던스", "중기(1~2분기)") and r.score_adjustment == 8 and len(r.evidence) >= 1


def test_symbols_and_insight(spark):
    a = spark.createDataFrame([(1, "카카오뱅크 실적이 개선됐다.", "카카오뱅크는 " * 3 + "충분히 긴 첫 문장이 여기에 있어서 요약으로 쓰인다."), (2, "an alarm went off", "x"), (3, None, None)], "article_id long, title string, body string")
    m = news.match_symbols(a, DICTIONARY)
    got = {r.article_id: [x.symbol for x in r.matches] for r in m.collect()}
    assert got == {1: ["323410"], 2: [], 3: []}
    base = news.rule_insight(m.where("title is not null"), news.keywords(a.where("title is not null")))
    one = {r.article_id: r for r in base.collect()}[1]
    assert one.sectors == ["은행"] and one.sentiment == "긍정" and "카카오뱅크" in one.keywords and one.market_view.startswith("은행")
    replies = spark.createDataFrame([(1, 'ok ```json\n{"sentiment": "부정", "sentimentScore": 10.5, "keywords": [" a ", ""], "materiality": "huge", "scoreAdjustment": "-99"}\n```', "llm", "m"), (2, "}{", "llm", "m")], "article_id long, reply string, engine string, model string")
    merged = {r.article_id: r for r in news.merge_llm_insight(base, replies).collect()}
    assert (merged[1].sentiment, merged[1].sentiment_score, merged[1].keywords, merged[1].score_adjustment, merged[1].engine) == ("부정", 11, ["a"], -8, "llm")
    assert merged[1].materiality == one.materiality and merged[2].engine == "규칙 기반"


def test_feed_list_and_robots(spark):
    feed = """<rss version="2.0"><channel><item><title><![CDATA[첫 기사 &amp; 제목]]></title><link>https://n.example/v/1?utm_source=rss&amp;section=a</link><description>d</description><pubDate>Thu, 27 Aug 2026 18:18:07 +0900</pubDate></item><item><title></title><link>x</link></item></channel></rss>"""
    pages = spark.createDataFrame([("https://n.example/rss", feed)], "url string, body string")
    assert column(spark, [feed, "<?xml?><urlset></urlset>"], feeds.looks_like_feed) == [True, False]
    (item,) = feeds.parse_feed(pages, now()).collect()
    assert (item.title, item.url) == ("첫 기사 & 제목", "https://n.example/v/1") and item.published_at is not None
    html = """<ul><li><a href="/news/view/1?section=a">열두 글자가 넘는 첫 번째 기사 제목</a><img src="/2019/06/26/x.jpg"><span class="txt-time">08-27 18:18</span></li><li><a href="/news/view/2">열두 글자가 넘는 두 번째 기사 제목</a><time datetime="2026-08-27T08:00:00Z"></time></li></ul>
    <div><ul><li><a href="/popular">날짜가 없는 많이 본 기사 링크 제목</a></li></ul></div><a href="/news/2">2</a><a href="/news/3">3</a>"""
    listed = spark.createDataFrame([("https://n.example/news", html)], "url string, html string")
    got = sorted((r.url, r.published_at.isoformat()) for r in feeds.parse_news_list(listed, now()).collect())
    assert [u for u, _ in got] == ["https://n.example/news/view/1", "https://n.example/news/view/2"]
    assert feeds.discover_links(listed).first().next_page_url == "https://n.example/news/2"
    robots = spark.createDataFrame([("https://n.example", 200, "User-agent: *\nDisallow: /\n\nUser-agent: ExampleBot\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow:"), ("https://down.example", 503, "")], "origin string, status int, text string")
    u = spark.createDataFrame([(x,) for x in ("https://n.example/a", "https://n.example/private/x", "https://n.example/private/open/y", "https://n.example/a.pdf", "https://n.example/a.pdfx", "https://down.example/a", "https://other.example/a")], "url string")
    got = {r.url.split("//")[1]: r.allowed for r in feeds.robots_filter(u, feeds.robots_rules(robots, "examplebot")).collect()}
    assert got == {"n.example/a": True, "n.example/private/x": False, "n.example/private/open/y": True, "n.example/a.pdf": False, "n.example/a.pdfx": True, "down.example/a": False, "other.example/a": True}


def test_insert_counts_once(spark):
    a = spark.createDataFrame([(1, 7, "u"), (2, 7, "u"), (3, 8, "v")], "article_id long, source_id int, canonical_url string")
    new, counts = archive.insert_new_articles(a, a.limit(0))
    assert {r.article_id for r in new.collect()} == {1, 3} and {r.source_id: r.inserted for r in counts.collect()} == {7: 1, 8: 1}
    assert archive.insert_new_articles(a, new)[1].count() == 0


@pytest.mark.parametrize(("hours", "want"), [(None, 36), (0.0, 36), (float("nan"), 36), (3.0, 6), (1e9, 168), (48.9, 48)])
def test_window_hours(spark, hours, want):
    df = spark.createDataFrame([(hours,)], "h double")
    assert df.select(archive.clamp_window_hours(F.col("h")).alias("x")).first().x == want


def test_pages_by_index_equal_pages_by_offset(spark):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i * 37 % 400) if i % 5 else None) for i in range(1000)]
    a = spark.createDataFrame(rows, "article_id long, published_at timestamp").repartition(7)
    index = archive.archive_index(a, 64)
    assert index.count() == 16
    ids = lambda df: [r.article_id for r in df.collect()]
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or datetime(1970, 1, 1)).timestamp(), -r[0]))]
    for page in (1, 2, 7, 8, 20, 34, 35):
        assert ids(archive.indexed_page(a, index, page, 30, 64)) == order[(page - 1) * 30 : page * 30]
    at, read = None, []
    first = archive.archive_page(a, 1, 90).collect()
    while first:
        read += [r.article_id for r in first]
        at = first[-1]
        first = archive.archive_after(a, at.published_at, at.article_id, 90).collect()
    assert read == order


def test_search_by_index_equals_a_scan_and_reads_one_folder(spark, tmp_path, capsys):
    texts = ["The tide turns", "A TIDE table", "no such word", None, "", "ti", "Ünï tidé", "the the", "tide\ntide"]
    rows = spark.createDataFrame([(i, t, "b" + (t or ""), (t or "").lower().split(" ")) for i, t in enumerate(texts * 5)], "article_id long, title string, body string, words array<string>")
    grams, words = str(tmp_path / "grams"), str(tmp_path / "words")
    search.write_index(search.text_postings(rows, ["title", "body"]), grams)
    search.write_index(search.keyword_postings(rows, "words"), words)
    ids = lambda df: sorted(r.article_id for r in df.collect())
    for part in ("tide", "TIDE t", "bti", "ti", "", "tidé", "zzz", "e\nt", "the the"):
        want = [i for i, t in enumerate(texts * 5) if any(part.lower() in x.lower() for x in ((t or "\0") if t is not None else "\0", "b" + (t or "")))]
        assert ids(search.search_text(rows, ["title", "body"], grams, part)) == want, part
    for word in ("tide", "the", "ti", "tid", ""):
        assert ids(search.search_keyword(rows, words, word)) == [i for i, t in enumerate(texts * 5) if word in (t or "").lower().split(" ")]
    search.search_keyword(rows, words, "tide").explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,tide)" in plan


def test_a_page_of_many_items_leaves_in_small_batches(spark, monkeypatch):
    """Candidates leave a task a few at a time, and none is lost between."""
    from tidemark.sources import feeds

    monkeypatch.setattr(feeds, "ROWS", 2)
    items = "".join(f'<li><span class="time">2024.01.15 10:00</span><a href="/a/{i}">a title of twelve letters {i}</a></li>' for i in range(7))
    pages = spark.createDataFrame([("https://x.example/list", items), ("https://x.example/none", None)], "url string, html string")
    rows = feeds.parse_news_list(pages, F.lit("2024-01-16").cast("timestamp")).collect()
    assert sorted(r.url for r in rows) == [f"https://x.example/a/{i}" for i in range(7)]


def test_an_index_holds_a_posting_once(spark, monkeypatch, tmp_path):
    """Repeated rows meet in one share of their folder, and a folder has no more files than shares."""
    from tidemark.operators import search

    monkeypatch.setattr(search, "SHARES", 2)
    rows = spark.createDataFrame([(t, i) for t in ("one", "two", None) for i in range(50)] * 3, "term string, article_id long").repartition(4)
    search.write_index(rows, str(tmp_path / "i"), 1)
    assert spark.read.parquet(str(tmp_path / "i")).count() == 100 and len(list((tmp_path / "i" / "bucket=0").glob("*.parquet"))) <= 2
