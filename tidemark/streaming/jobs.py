"""Streaming forms of the ingest and dashboard jobs."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tidemark.operators.news import retry_outcomes

# What a run's state is called.
DONE, FAILED = "완료", "오류"


def unique_items(items: DataFrame, key: str = "canonical_url", window: str = "36 hours") -> DataFrame:
    """A stream's items without those that are too late, and without repeats of a key while its window lasts."""
    return items.withWatermark("published_at", window).dropDuplicatesWithinWatermark([key])


def cadence_counts(events: DataFrame, minutes: int, by: str = "source_id", late: str = "1 hour") -> DataFrame:
    """Counts per source and interval; an interval's end is the next run's time."""
    w = F.window("ts", f"{minutes} minutes")
    return events.withWatermark("ts", late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.end").alias("next_run"), by, "n")


def trailing_mentions(events: DataFrame, window: str = "48 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Mentions per symbol over a sliding window."""
    w = F.window("ts", window, slide)
    return events.withWatermark("ts", late).groupBy(w, "symbol").agg(F.count("*").alias("n")).select(F.col("window.end").alias("until"), "symbol", "n")


def reused_reports(log: DataFrame, minutes: int = 20, late: str = "10 minutes") -> DataFrame:
    """(digest, request_id, ts, report_id) for each request of a stream of requests and outcomes (digest, ts, kind, id, ok): the young report that answers it, null if a new one is needed.

    Only a successful outcome is kept, by fingerprint and for `minutes` of event time; a failure is never reused and leaves an earlier success as it is. Rows of a micro-batch are taken in order of time
    and id; a fingerprint's state goes once the watermark has passed its end.
    """
    span = timedelta(minutes=minutes)

    def answered(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])  # a fingerprint's rows of one micro-batch
        last, at = state.get if state.exists else (None, None)
        out = []
        for ts, kind, id, ok in zip(rows["ts"], rows["kind"], rows["id"], rows["ok"]):
            if kind == "request":
                young = at is not None and timedelta(0) <= ts.to_pydatetime() - at <= span
                out.append((key[0], id, ts, last if young else None))
            elif ok is not None and bool(ok):
                last, at = id, ts.to_pydatetime()
        if last is not None:
            state.update((last, at))
            end = int(pd.Timestamp(at + span).timestamp() * 1000)
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["digest", "request_id", "ts", "report_id"])

    schema = "digest string, request_id long, ts timestamp, report_id long"
    rows = log.withWatermark("ts", late).select("digest", "ts", "kind", "id", "ok")
    return rows.groupBy("digest").applyInPandasWithState(answered, schema, "report_id long, at timestamp", "append", "EventTimeTimeout")


def reaped_runs(log: DataFrame, minutes: int = 30, late: str = "10 minutes", buckets: int = 4096) -> DataFrame:
    """(run_id, status, at) of runs that have ended or hung, from a stream of their starts and ends (run_id, ts, kind): a run without an end for `minutes` of event time is failed at that time, by a timer.

    Runs are kept by buckets of their id's hash, so that a call settles all rows of a bucket at once and not a run's two or three; a bucket's state is its runs that are open, its timer the first of their ends.
    """
    span = minutes * 60_000_000

    def settled(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(zip(*state.get, strict=True) if state.exists else [], columns=["run_id", "ts"], dtype="int64").assign(end=False)
        now, done = state.getCurrentWatermarkMs() * 1000, []  # microseconds
        if not state.hasTimedOut:
            came = pd.concat(list(frames))  # a bucket's rows of one micro-batch
            came = pd.DataFrame({"run_id": came["run_id"], "ts": came["us"], "end": came["kind"] != "start"})
            quiet = held[~held["run_id"].isin(came["run_id"])]
            # what is held comes first, then starts before ends; a run begins with its first start after an end
            rows = pd.concat([held.drop(quiet.index), came.sort_values(["ts", "end"], kind="stable")]).sort_values("run_id", kind="stable", ignore_index=True)
            ends = rows.groupby("run_id")["end"]
            rows = rows.assign(turn=ends.cumsum() - rows["end"], turns=ends.transform("sum"))
            begun = rows[~rows["end"]].drop_duplicates(["run_id", "turn"])
            over = begun[["run_id", "turn", "ts"]].merge(rows.loc[rows["end"], ["run_id", "turn", "ts"]], on=["run_id", "turn"], suffixes=("", "_end"))
            fine = over["ts_end"] - over["ts"] <= span
            done.append(pd.DataFrame({"run_id": over["run_id"], "status": fine.map({True: DONE, False: FAILED}), "at": over["ts_end"].where(fine, over["ts"] + span)}))
            held, young = quiet, begun[begun["turn"] == begun["turns"]]
        else:
            young = held[:0]
        hung = held["ts"] + span < now
        done.append(pd.DataFrame({"run_id": held.loc[hung, "run_id"], "status": FAILED, "at": held.loc[hung, "ts"] + span}))
        stay = pd.concat([held.loc[~hung, ["run_id", "ts"]], young[["run_id", "ts"]]])
        if len(stay):
            state.update((stay["run_id"].tolist(), stay["ts"].tolist()))
            state.setTimeoutTimestamp(max((int(stay["ts"].min()) + span) // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.concat(done)

    rows = log.withWatermark("ts", late).select("run_id", "ts", F.unix_micros("ts").alias("us"), "kind", F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket"))
    found = rows.groupBy("bucket").applyInPandasWithState(settled, "run_id long, status string, at long", "runs array<long>, begun array<long>", "append", "EventTimeTimeout")
    return found.withColumn("at", F.timestamp_micros("at"))


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into Parquet (append) and gives its rows as a batch; states are kept beside them."""
    spark = stream.sparkSession
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def insert_stream(items: DataFrame, store: str, state: str, buckets: int = 256):
    """Appends a stream's items to a Parquet store unless it has their canonical_url already.

    The store is laid out by buckets of the URL's hash, and a micro-batch reads only the URLs of buckets that it has items for. The folder is made before the stream starts, so an empty store is no error.
    """
    spark = items.sparkSession
    bucket = F.pmod(F.xxhash64("canonical_url"), F.lit(buckets)).cast("int")
    schema = items.withColumns({"batch": F.lit(0).cast("long"), "bucket": bucket}).schema
    spark.createDataFrame([], schema).write.mode("append").partitionBy("bucket").parquet(store)

    def insert(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["canonical_url"]).withColumns({"batch": F.lit(number).cast("long"), "bucket": bucket})
        held = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
        known = batch.sparkSession.read.schema(schema).parquet(store).where(F.col("bucket").isin(held)).select("canonical_url", "bucket")
        # rows of a batch that runs again after a failure are in the store already, so they are left out
        new.join(known, ["canonical_url", "bucket"], "left_anti").select(*schema.fieldNames()).write.mode("append").partitionBy("bucket").parquet(store)

    return items.writeStream.foreachBatch(insert).option("checkpointLocation", state).trigger(availableNow=True).start()


def insight_stream(pending: DataFrame, analyse, sink, failed, state: str):
    """Analyses a stream of waiting articles in micro-batches: analyse(batch) gives insights, sink(insights, number) upserts them (see upsert_insights), and failed(articles, number) gets the
    articles without one, whose attempts and states retry_outcomes() says. A batch that runs again changes nothing if both write by its number."""

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates(["article_id"]).persist()
        found = analyse(batch).persist()
        sink(found, number)
        lost = batch.join(found.select("article_id"), "article_id", "left_anti")
        failed(retry_outcomes(batch, lost).join(lost.select("article_id"), "article_id", "left_semi"), number)
        found.unpersist()
        batch.unpersist()

    return pending.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()


def fetched_items(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages to parse, status by source) of fetched pages (source_id, status, body): an unchanged page (304) gives no rows."""
    unchanged = F.col("status") == 304
    state = F.when(unchanged, "변경 없음").when(F.col("status") == 200, "완료").otherwise("오류")
    return pages.where(F.col("status") == 200), pages.select("source_id", state.alias("state"))
