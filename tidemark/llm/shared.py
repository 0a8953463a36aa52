"""What several corpus operators need: saved tables, checked broadcasts, spread prefix sums, components."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers a row may be broadcast (some ten MB).
BROADCAST_ROWS = 100_000

#: Folders of applications whose session names none.
UNSET: dict[str, str] = {}

#: Bytes of a piece of a text, of which Spark puts 10,000 in an Arrow batch.
PIECE = 512

#: ASCII white space, as Java and Python string literals write it.
BLANKS = " \t\n\x0b\x0c\r"


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names; a temporary one only for a session within one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = UNSET.get(app) or UNSET.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: a lost executor costs no recomputation."""
    path = f"{workspace(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that working columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a saved table that has been counted and is small; else the table as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def chunks_for(rows: int, each: int = 500, most: int = 1 << 20) -> int:
    """A power of two: how many chunks of about so many rows."""
    return max(1, min(most, 1 << max(0, (rows // each)).bit_length()))


def running_totals(df: DataFrame, keys: list[str], chunk: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds, per key, the sum of value over the rows before this one by (chunk, order).

    No task gets a whole key: sums per chunk are added up first (a row for each chunk),
    then each chunk is ordered by itself. df must be a saved table or otherwise repeatable.
    """
    ahead = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    starts = saved(starts.select(*keys, chunk, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start")))
    total = F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return df.join(starts, [*keys, chunk]).withColumn(name, total).drop("_start")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node reachable.

    Alternates the large-star and small-star steps, each a shuffle on a node, until all edges are stars: every node has one smaller neighbour or is one.
    A node's neighbours are never gathered: only their minimum is, which Spark combines before the shuffle.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def done(df: DataFrame) -> bool:
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(df.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()

    while not done(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # each larger neighbour of a node is tied to the smallest node around it
        large = now.join(low.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
        mid = saved(large.where("a <> b").distinct())
        low = mid.groupBy("a").agg(F.min("b").alias("m"))
        # each smaller neighbour of a node, and the node, are tied to the smallest of them
        star = mid.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = saved(star.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def per_worker(key: tuple, make: Callable):
    """make(), once for each Python worker and key; functions are sent by value, so their modules can't remember it."""
    store = sys.modules.setdefault("_tidemark_worker", ModuleType("_tidemark_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def in_pieces(rows: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of rows, then piece (int) and text (binary): a row for each PIECE bytes of a text, in order and within one task. A null text is empty; an empty one has one piece.

    Spark ends an Arrow batch by its number of rows, so batches of whole texts take as much memory as their texts do, twice while they grow, in
    the executor and in its Python workers; batches of pieces are bounded, and so are their cells. whole_texts() puts them together again.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    # the array of one binds the bytes, else each piece would make them anew
    cut = F.transform(F.array(raw), lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(b), F.lit(1)), F.lit(PIECE)), lambda i: F.substring(b, i, F.lit(PIECE))))
    keys = [F.col(f"`{c}`") for c in rows.columns if c != text]
    # outer: no filter on the pieces' number, which would cut each text twice
    return rows.select(*keys, F.get(cut, F.lit(0)).alias("pieces")).select(*keys, F.posexplode_outer("pieces").alias("piece", "text"))


def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of in_pieces() with the texts whole again: its other columns, then text (string)."""

    def made(keys: list[pa.Array], at: np.ndarray, data: pa.Buffer | None) -> pa.RecordBatch:
        text = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int32)), data if data is not None else pa.py_buffer(b""))
        return pa.RecordBatch.from_arrays([*keys, text], [*names, "text"])

    def joined() -> pa.RecordBatch:
        data = b"".join(piece for part in held for piece in part.columns[-1].to_pylist())
        return made(held[0].slice(0, 1).columns[:-2], np.array([0, len(data)]), pa.py_buffer(data))

    held: list[pa.RecordBatch] = []  # the pieces of a text that may go on in the next batch
    names: list[str] = []
    for batch in batches:
        names = batch.schema.names[:-2]
        firsts = np.flatnonzero(batch.columns[-2].to_numpy() == 0)
        if not len(firsts):
            held.append(batch)
            continue
        if held:
            held.append(batch.slice(0, firsts[0]))
            yield joined()
        if len(firsts) > 1:
            pieces = batch.columns[-1]
            ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset :]
            yield made([c.take(pa.array(firsts[:-1])) for c in batch.columns[:-2]], ends[firsts], pieces.buffers()[2])
        held = [batch.slice(firsts[-1])]
    if held:
        yield joined()


def cut_without_loss(df: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """df without the rows whose keys (null-safe) are in gone, a saved table: broadcast if a count shows it to be small, else by shuffle."""
    gone = small(gone.select(*[F.col(c).alias(f"_gone_{c}") for c in on]).distinct())
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_gone_{c}"))
    return df.join(gone, same, "left_anti")
