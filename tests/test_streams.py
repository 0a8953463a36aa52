"""Streams over small folders."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import jobs, store

T = datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema):
    """Rows as a stream of files, one each."""
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_insert_and_insights(spark, tmp_path):
    schema = "article_id long, canonical_url string, published_at timestamp"
    items = stream(spark, tmp_path, [(1, "a", T), (2, "a", T), (3, "b", T)], schema)
    store = str(tmp_path / "store")
    for n in range(2):  # the second stream finds all in the store
        jobs.insert_stream(items, store, str(tmp_path / f"state{n}")).awaitTermination()
    assert sorted(r.canonical_url for r in spark.read.parquet(store).collect()) == ["a", "b"]
    seen = []
    waiting = items.withColumns({"attempts": F.lit(2), "insight_status": F.lit("대기")})
    lost = []
    jobs.insight_stream(waiting, lambda b: b.where("article_id <> 2").select("article_id"), lambda i, n: seen.extend(r.article_id for r in i.collect()), lambda a, n: lost.extend((r.article_id, r.attempts, r.insight_status) for r in a.collect()), str(tmp_path / "s")).awaitTermination()
    assert sorted(seen) == [1, 3] and lost == [(2, 3, "오류")]


def given(spark, path, rows, schema):
    """Another file of a stream's folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_failed_reports_are_never_reused(spark, tmp_path):
    schema, path, at = "digest string, ts timestamp, kind string, id long, ok boolean", str(tmp_path / "in"), lambda m: T + timedelta(minutes=m)
    out = lambda: {r.request_id: r.report_id for r in jobs.drained(jobs.reused_reports(spark.readStream.schema(schema).parquet(path)), str(tmp_path / "out")).collect()}
    given(spark, path, [("d", at(0), "request", 1, None), ("d", at(1), "outcome", 10, False), ("d", at(2), "request", 2, None), ("d", at(3), "outcome", 11, True), ("d", at(4), "request", 3, None), ("e", at(5), "request", 4, None)], schema)
    assert out() == {1: None, 2: None, 3: 11, 4: None}
    # a later start knows what was kept; a failure leaves it as it is; it ends after twenty minutes
    given(spark, path, [("d", at(10), "outcome", 12, False), ("d", at(11), "request", 5, None), ("d", at(24), "request", 6, None), ("e", at(6), "outcome", 13, True), ("e", at(7), "request", 7, None)], schema)
    assert out() == {1: None, 2: None, 3: 11, 4: None, 5: 11, 6: None, 7: 13}
    given(spark, path, [("x", at(90), "request", 8, None)], schema)
    given(spark, path, [("d", at(91), "request", 9, None)], schema)
    assert {k: v for k, v in out().items() if k > 7} == {8: None, 9: None}


def test_runs_without_an_end_are_failed_by_a_timer(spark, tmp_path):
    schema, path, at = "run_id long, ts timestamp, kind string", str(tmp_path / "in"), lambda m: T + timedelta(minutes=m)
    out = lambda: {(r.run_id, r.status, r.at) for r in jobs.drained(jobs.reaped_runs(spark.readStream.schema(schema).parquet(path)), str(tmp_path / "out")).collect()}
    given(spark, path, [(1, at(0), "start"), (1, at(30), "end"), (2, at(0), "start"), (2, at(31), "end"), (3, at(5), "start"), (4, at(20), "start")], schema)
    ended = {(1, "완료", at(30)), (2, "오류", at(30))}
    assert out() == ended
    given(spark, path, [(4, at(40), "end"), (5, at(50), "start")], schema)
    assert out() == ended | {(4, "완료", at(40)), (3, "오류", at(35))}


def test_runs_of_a_bucket_are_settled_together(spark, tmp_path):
    """Runs that begin and end several times, against a plain loop; two calls settle all."""
    r, schema, path = random.Random(4), "run_id long, ts timestamp, kind string", str(tmp_path / "in")
    log = sorted({(r.randint(0, 40), r.randint(0, 400), r.choice(["start", "start", "end"])) for _ in range(300)}, key=lambda x: (x[1], x[2] == "end", x[0]))
    at, want, begun = lambda m: T + timedelta(minutes=m), [], {}
    for run, t, kind in log:
        if kind == "start":
            begun.setdefault(run, t)
        elif run in begun:
            b = begun.pop(run)
            want.append((run, "완료", at(t)) if t - b <= 30 else (run, "오류", at(b + 30)))
    want += [(k, "오류", at(b + 30)) for k, b in begun.items() if b + 30 < max(t for _, t, _ in log) - 10]
    given(spark, path, [(k, at(t), kind) for k, t, kind in log], schema)
    out = jobs.drained(jobs.reaped_runs(spark.readStream.schema(schema).parquet(path), buckets=2), str(tmp_path / "out")).collect()
    assert len(want) > 50 and sorted((x.run_id, x.at, x.status) for x in out) == sorted((k, t, s) for k, s, t in want)


def test_store_takes_a_batch_once_and_survives_a_fall_between_its_files(spark, tmp_path):
    schema = "key string, v long, n long"
    s = store.UpsertStore(spark, str(tmp_path / "store"), schema, "key", buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    held = lambda: {r.key: r.v for r in store.UpsertStore(spark, str(tmp_path / "store"), schema, "key", buckets=4).read().collect()}
    newest = store.newest_of("n", "key")
    assert held() == {} and s.apply(rows(("a", 1, 1), ("b", 2, 1)), "x", 0, newest) and held() == {"a": 1, "b": 2}
    assert not s.apply(rows(("a", 9, 9)), "x", 0, newest) and held() == {"a": 1, "b": 2}
    commit, s.commit = s.commit, lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
    try:
        s.apply(rows(("a", 5, 2), ("c", 3, 1)), "x", 1, newest)
    except RuntimeError:
        pass
    assert held() == {"a": 1, "b": 2}
    s.commit = commit
    assert s.apply(rows(("a", 5, 2), ("c", 3, 1)), "x", 1, newest) and held() == {"a": 5, "b": 2, "c": 3}
    assert s.apply(rows(("a", 4, 1)), "y", 0, newest) and held()["a"] == 5  # an older row of another stream
    assert s.apply(rows(("b", None, 1)), "y", 1, lambda old, new: old.join(new.select("key"), "key", "left_anti")) and held() == {"a": 5, "c": 3}


def test_stream_into_a_store_is_killed_and_started_again(spark, tmp_path):
    schema, path = "article_id long, v string, n long", str(tmp_path / "in")
    for i in range(4):
        given(spark, path, [(k, f"{k}.{i}", i) for k in range(i, 20 + i)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    s = store.UpsertStore(spark, str(tmp_path / "store"), schema, "article_id", buckets=3)
    newest, calls, commit = store.newest_of("n", "article_id"), [], s.commit

    def falls(*args):
        calls.append(args[0])
        if len(calls) == 3:
            raise RuntimeError("killed")
        commit(*args)

    s.commit = falls
    q = store.upsert_stream(stream, s, newest, "s", str(tmp_path / "state"))
    try:
        q.awaitTermination()
    except Exception:
        pass
    assert q.exception() is not None and len(calls) == 3
    s.commit = commit
    store.upsert_stream(stream, s, newest, "s", str(tmp_path / "state")).awaitTermination()
    assert {r.article_id: r.n for r in s.read().collect()} == {k: max(i for i in range(4) if i <= k < 20 + i) for k in range(23)}


def test_insights_and_symbols_in_stores(spark, tmp_path):
    t = datetime(2024, 1, 2)
    insights = store.UpsertStore(spark, str(tmp_path / "i"), "article_id long, summary string, attempts int, error string, created_at timestamp, updated_at timestamp", "article_id", 2)
    symbols = store.UpsertStore(spark, str(tmp_path / "s"), "article_id long, symbol string", "article_id", 2)
    sink = store.insight_sink(insights, symbols, "analysis")
    found = lambda *r: spark.createDataFrame(list(r), "article_id long, summary string")
    named = lambda *r: spark.createDataFrame(list(r), "article_id long, symbol string")
    for _ in range(2):
        sink(found((1, "a"), (2, "b")), named((1, "X"), (1, "Y"), (2, "X")), 0, t)
    for _ in range(2):
        sink(found((1, "c")), named((1, "Z")), 1, t)
    assert sorted((r.article_id, r.summary, r.attempts) for r in insights.read().collect()) == [(1, "c", 2), (2, "b", 1)]
    assert sorted((r.article_id, r.symbol) for r in symbols.read().collect()) == [(1, "Z"), (2, "X")]


def test_unchanged_pages(spark):
    pages, state = jobs.fetched_items(spark.createDataFrame([(1, 200, "x"), (2, 304, None), (3, 500, None)], "source_id int, status int, body string"))
    assert pages.count() == 1 and {r.source_id: r.state for r in state.collect()} == {1: "완료", 2: "변경 없음", 3: "오류"}
