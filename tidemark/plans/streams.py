"""Streaming queries, run over the events that are there and given as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources.tables import folder
from tidemark.streaming import jobs, store


def events(spark, d):
    """events as a stream."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("symbol"), "event_type")


@query("""WITH e AS (SELECT user_id::VARCHAR AS symbol, event_type, ts::TIMESTAMP AS ts FROM events),
a AS (SELECT symbol, event_type, max(ts) AS ts FROM e WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2), b AS (SELECT symbol, event_type, min(ts) AS ts FROM e WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2)
SELECT symbol, event_type, (a.ts IS NOT NULL)::INT + (b.ts IS NOT NULL AND (a.ts IS NULL OR a.ts + INTERVAL 36 HOUR <= (SELECT max(ts) FROM a) - INTERVAL 36 HOUR))::INT AS n FROM a FULL JOIN b USING (symbol, event_type)""")
def st2_unique_items(spark, d):
    """ST1, ST2: of each user and kind the last event of the first half of a month and the first of the second: the second is new only once the window of 36 hours has passed for the first."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("symbol"), "event_type", F.col("ts").cast("timestamp").alias("published_at"))
    early = F.col("published_at") < F.lit("2024-01-16").cast("timestamp")
    path = folder(spark)
    for half, pick in ((e.where(early), F.max), (e.where(~early), F.min)):
        half.groupBy("symbol", "event_type").agg(pick("published_at").alias("published_at")).write.mode("append").parquet(f"{path}/in")
        s = spark.readStream.schema(e.schema).parquet(f"{path}/in").withColumn("canonical_url", F.concat_ws("/", "symbol", "event_type"))
        out = jobs.drained(jobs.unique_items(s), path)
    return out.groupBy("symbol", "event_type").agg(F.count("*").cast("int").alias("n"))


@query("SELECT epoch_ms(time_bucket(INTERVAL 30 MINUTE, ts::TIMESTAMP) + INTERVAL 30 MINUTE) AS next_run, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 30 MINUTE, ts::TIMESTAMP) + INTERVAL 30 MINUTE <= (SELECT max(ts)::TIMESTAMP - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")
def st5_cadence(spark, d):
    """ST5: counts by half hours that have closed."""
    out = jobs.drained(jobs.cadence_counts(events(spark, d), 30, "event_type"), folder(spark))
    return out.select(F.unix_millis("next_run").alias("next_run"), "event_type", "n")


@query("""WITH w AS (SELECT user_id::VARCHAR AS symbol, unnest(range(time_bucket(INTERVAL 12 HOUR, ts::TIMESTAMP) + INTERVAL 12 HOUR, time_bucket(INTERVAL 12 HOUR, ts::TIMESTAMP) + INTERVAL 60 HOUR, INTERVAL 12 HOUR)) AS until FROM events)
SELECT epoch_ms(until) AS until, symbol, count(*) AS n FROM w WHERE until <= (SELECT max(ts)::TIMESTAMP - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def st6_trailing_mentions(spark, d):
    """ST6: mentions within 48 hours, every twelve."""
    out = jobs.drained(jobs.trailing_mentions(events(spark, d), "48 hours", "12 hours"), folder(spark))
    return out.select(F.unix_millis("until").alias("until"), "symbol", "n")


@query("""WITH e AS (SELECT event_id AS id, user_id::VARCHAR AS digest, ts::TIMESTAMP AS ts, event_type AS k FROM events),
r AS (SELECT * FROM e WHERE k IN ('view', 'click')), o AS (SELECT * FROM e WHERE k = 'purchase'),
n AS (SELECT r.id, r.digest, o.id AS report_id, o.ts AS made, r.ts FROM r ASOF LEFT JOIN o ON r.digest = o.digest AND r.ts >= o.ts)
SELECT id AS request_id, digest, CASE WHEN ts - made <= INTERVAL 12 HOUR THEN report_id END AS report_id FROM n""")
def st7_reused_reports(spark, d):
    """ST7, ST1: views and clicks as requests, purchases and errors as reports that came about or failed: only young successes are reused."""
    k = F.col("event_type")
    kind = F.when(k.isin("view", "click"), "request").when(k.isin("purchase", "error"), "outcome")
    log = events(spark, d).select(F.col("symbol").alias("digest"), "ts", kind.alias("kind"), F.col("event_id").alias("id"), (k == "purchase").alias("ok")).where("kind is not null")
    return jobs.drained(jobs.reused_reports(log, 720), folder(spark)).select("request_id", "digest", "report_id")


@query("""WITH o AS (SELECT o_orderkey AS run_id, o_orderdate::TIMESTAMP + to_minutes(o_orderkey % 1440) AS s, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::TIMESTAMP + to_minutes(o_orderkey % 1440 + o_orderkey % 60) END AS e FROM orders),
w AS (SELECT greatest(max(s), max(e)) - INTERVAL 10 MINUTE AS mark FROM o)
SELECT run_id, CASE WHEN e <= s + INTERVAL 30 MINUTE THEN '완료' ELSE '오류' END AS status, epoch_ms(CASE WHEN e <= s + INTERVAL 30 MINUTE THEN e ELSE s + INTERVAL 30 MINUTE END) AS at FROM o, w WHERE e IS NOT NULL OR s + INTERVAL 30 MINUTE < mark""")
def st4_reaped_runs(spark, d):
    """ST4: orders as starts and ends of crawl runs: those without an end within half an hour are failed by a timer."""
    schema = spark.read.parquet(f"{d}/orders.parquet").schema
    o = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/orders*.parquet")
    k = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(k % 1440).cast("int"))
    ends = F.when(F.col("o_orderstatus") != "P", start + F.make_dt_interval(mins=(k % 60).cast("int")))
    log = o.select(k.alias("run_id"), F.explode(F.array(F.struct(start.alias("ts"), F.lit("start").alias("kind")), F.struct(ends.alias("ts"), F.lit("end").alias("kind")))).alias("x")).select("run_id", "x.ts", "x.kind").where("ts is not null")
    return jobs.drained(jobs.reaped_runs(log), folder(spark)).select("run_id", "status", F.unix_millis("at").alias("at"))


@query("SELECT user_id::VARCHAR AS symbol, event_type, max(event_id) AS event_id, epoch_us(arg_max(ts, event_id)::TIMESTAMP) AS ts FROM events GROUP BY 1, 2")
def st3_upsert_store(spark, d):
    """ST3, IO15, IO16: events as upserts, the latest of a user and kind stays; what has been applied is given again and changes nothing."""
    rows = events(spark, d).withColumn("key", F.concat_ws("/", "symbol", "event_type")).select("key", "symbol", "event_type", "event_id", "ts")
    path = folder(spark)
    held = store.UpsertStore(spark, f"{path}/store", rows.schema, "key")
    merge = store.newest_of("event_id", "key")
    for name, part in (("even", rows.where("event_id % 2 = 0")), ("odd", rows.where("event_id % 2 = 1")), ("even", rows.where("event_id % 2 = 0"))):
        store.upsert_stream(part, held, merge, name, f"{path}/{name}").awaitTermination()
    return held.read().select("symbol", "event_type", "event_id", F.unix_micros("ts").alias("ts"))
