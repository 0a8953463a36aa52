"""A store that takes upserts: buckets of Parquet files, written anew where a batch changes them, with a ledger of what has been applied."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.archive import replace_symbols, upsert_insights

LEDGER = "version long, stream string, batch long, bucket int, files long"


class UpsertStore:
    """Rows by key under a folder that Spark reaches.

    Each change writes the buckets it touches under its version (data/version=v/bucket=b) and then one ledger file (ledger/version=v), which says of every bucket in which version its rows stand and which batch
    of which stream was applied. Readers go by the latest ledger file, so they see all of a change or nothing. A change that fails on its way leaves files that no ledger names; the next one takes the
    same version and overwrites them. A batch that the ledger names is applied no more. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        spark.createDataFrame([], LEDGER).write.mode("append").partitionBy("version").parquet(f"{self.path}/ledger")

    def bucket(self) -> Column:
        """A row's bucket."""
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def state(self) -> tuple[int, dict[int, int], dict[str, int]]:
        """(latest version, version of each bucket's files, last batch of each stream): as many rows as there are buckets and streams."""
        kind = F.col("bucket").isNotNull().alias("data")
        ledger = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")
        latest = ledger.agg(F.max("version")).first()[0]
        rows = ledger.where(F.col("version") == latest).select("*", kind).collect() if latest is not None else []
        return latest or 0, {r.bucket: r.files for r in rows if r.data}, {r.stream: r.batch for r in rows if not r.data}

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The store's rows, or those of some buckets."""
        files = self.state()[1]
        return self.rows({b: v for b, v in files.items() if only is None or b in only})

    def rows(self, files: dict[int, int]) -> DataFrame:
        """The rows of buckets in versions; what a column was before it was added is null."""
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(files.items())])

    def apply(self, batch: DataFrame, stream: str, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Merges a batch into the buckets that it has keys for: merge(old, new) gives their rows. False if the batch has been applied before."""
        version, files, applied = self.state()
        if number <= applied.get(stream, -1):
            return False
        version += 1
        touched = sorted(r.b for r in batch.select(self.bucket().alias("b")).distinct().collect())
        if touched:
            old = self.rows({b: files[b] for b in touched if b in files})
            merged = merge(old, batch).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
            merged.withColumn("bucket", self.bucket()).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
            written = {r.bucket for r in self.spark.read.parquet(f"{self.path}/data/version={version}").select(F.col("bucket").cast("int").alias("bucket")).distinct().collect()} if not merged.isEmpty() else set()
            files = {b: v for b, v in files.items() if b not in touched} | dict.fromkeys(written, version)
        self.commit(version, files, applied | {stream: number})
        return True

    def commit(self, version: int, files: dict[int, int], applied: dict[str, int]) -> None:
        """One ledger file, which makes the change visible at once."""
        rows = [(None, None, b, v) for b, v in files.items()] + [(s, n, None, None) for s, n in applied.items()]
        self.spark.createDataFrame(rows, "stream string, batch long, bucket int, files long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/version={version}")


def newest_of(order: str, key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps, of the rows of a key, that of greatest order."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new.select(*old.columns))
        row = F.struct(*[F.col(f"`{c}`") for c in both.columns])
        return both.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.col(order)).alias("_row")).select("_row.*")

    return merge


def upsert_stream(rows: DataFrame, store: UpsertStore, merge: Callable[[DataFrame, DataFrame], DataFrame], name: str, state: str):
    """Applies a stream to a store, batch by batch; killed and started again with the same state and name it goes on where the ledger says."""
    return rows.writeStream.foreachBatch(lambda batch, number: store.apply(batch, name, number, merge)).option("checkpointLocation", state).trigger(availableNow=True).start()


def insight_sink(insights: UpsertStore, symbols: UpsertStore, name: str) -> Callable[[DataFrame, DataFrame, int, datetime], None]:
    """A sink of analysed articles (see insight_stream): insights are laid over those that are there, an article's symbols are replaced as a whole. A batch that runs again changes neither."""

    def sink(found: DataFrame, matched: DataFrame, number: int, now: datetime) -> None:
        insights.apply(found, name, number, lambda old, new: upsert_insights(old, new, now))
        symbols.apply(matched, name, number, replace_symbols)

    return sink
