"""Exact top-k search by blocks of documents, scored while their bounds reach the kth score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import saved

#: Vectors of a block, of a shard (one row of the saved index) and queries scored together.
BLOCK, SHARD, CHUNK = 256, 8192, 2048
#: Buckets of shards for each core: as often are the queries copied, however many vectors there are.
TURNS = 4
#: One shard of so many is searched first, for scores that prune the others.
FIRST = 16


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as double; null if the vector is null or holds null or a component that isn't finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def gathered(df: DataFrame, rows: int, each: int) -> DataFrame:
    """Rows (id, vector) in ranges of id, so many to a row: part (long), ids, matrix and first (binary: int64, float64 and bool), dims.

    first is false for a row that repeats another's id and vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, before = TaskContext.get().partitionId() << 32, [], None

        def out(ids: list, vectors: list) -> pa.RecordBatch:
            nonlocal number, before
            matrix, first = np.zeros((len(ids), max(map(len, vectors)))), np.ones(len(ids), bool)
            for i, v in enumerate(vectors):
                matrix[i, : len(v)] = v
                first[i] = before is None or before[0] != ids[i] or not np.array_equal(before[1], v)
                before = ids[i], v
            number += 1
            return pa.RecordBatch.from_pydict({"part": [number - 1], "ids": [np.asarray(ids, np.int64).tobytes()], "matrix": [matrix.tobytes()], "first": [first.tobytes()], "dims": [matrix.shape[1]]})

        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True)
            while len(held) >= each:
                yield out(*zip(*held[:each], strict=True))
                held = held[each:]
        if held:
            yield out(*zip(*held, strict=True))

    dealt = df.repartitionByRange(max(1, rows // each), "id").sortWithinPartitions("id", "vector")
    return dealt.mapInArrow(run, "part long, ids binary, matrix binary, first binary, dims long")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by (score descending, id)."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, block: int = BLOCK, first: np.ndarray | None = None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of the k best rows of x for each row of q, -inf where there are fewer, and how many blocks were scored.

    A block's bound for a query is the sum over dimensions of the largest value that the query's weight gives there. Each query takes its
    blocks in descending order of bounds, and stops at the first whose bound is below its kth score or below floor, a score that its kth is known to reach. The first row with the query's own id and vector doesn't count.
    """
    starts = range(0, len(x), block)
    high = np.stack([x[i : i + block].max(0) for i in starts])
    low = np.stack([x[i : i + block].min(0) for i in starts])
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    top, top_ids, scored = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max), 0
    floor = np.full(len(q), -np.inf) if floor is None else floor
    live = np.arange(len(q))
    for turn in range(len(high)):
        nth = order[live, turn]
        keep = bounds[live, nth] >= np.maximum(top[live, k - 1], floor[live])
        live, nth = live[keep], nth[keep]
        if not len(live):
            break
        for b in np.unique(nth):
            rows, at = live[nth == b], int(b) * block
            scores, names = q[rows] @ x[at : at + block].T, ids[at : at + block]
            for i, j in zip(*np.nonzero(own[rows][:, None] == names[None, :]), strict=True):
                if (first is None or first[at + j]) and np.array_equal(x[at + j], q[rows[i]]):
                    scores[i, j] = -np.inf
            hit = (scores.max(1) >= np.maximum(top[rows, k - 1], floor[rows])) & (scores.max(1) > -np.inf)
            rows, scores, scored = rows[hit], scores[hit], scored + len(rows)
            if len(rows):
                top[rows], top_ids[rows] = best(np.hstack([top[rows], scores]), np.hstack([top_ids[rows], np.broadcast_to(names, scores.shape)]), k)
    return top, top_ids, scored


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score) of the k candidates of highest inner product for each row of queries, ties to the smaller id.

    vectors and queries have id (long) and vector (array<double> of whole numbers, so sums are exact below 2 ** 53). Rows where either is
    null take no part; shorter vectors, empty ones too, count as filled up with zeros. Candidates are all vectors but the query's own row: one with its id and vector. Rows that repeat an id are queries
    and candidates of their own. An empty table on either side gives an empty table. Fewer than k candidates: as many rows.

    Vectors are gathered by ranges of id into shards of bounded size, queries into chunks. Each chunk meets each shard once, by an equi-join on
    numbered buckets (a few for each core, so that copies of the queries grow as the queries do), and keeps its k best there; blocks of a shard are pruned by their bounds. A first pass over some of the shards gives each query a kth score, which goes with it to all others, so
    that most of their blocks fall below it. Then the shards' k best are ranked.
    """
    fine = vectors.where("id is not null and vector is not null")
    asked = queries.where("id is not null and vector is not null")
    shards = saved(gathered(fine.select("id", "vector"), fine.count(), SHARD))
    chunks = saved(gathered(asked.select("id", "vector"), asked.count(), CHUNK).drop("first"))
    n = shards.count()
    buckets = max(1, min(TURNS * vectors.sparkSession.sparkContext.defaultParallelism, n))
    begun = F.pmod(F.xxhash64("part"), F.lit(FIRST)) == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, own, first = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["first"], bool)
                x, q = np.frombuffer(row["matrix"]).reshape(len(ids), row["dims"]), np.frombuffer(row["q"]).reshape(len(own), row["q_dims"])
                dims = max(x.shape[1], q.shape[1])  # what either lacks is zero
                x, q = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (x, q))
                floor = np.full(len(own), -np.inf)
                for f in row["floors"] or ():
                    floor[f["nth"]] = f["score"]
                scores, found, _ = search(x, ids, q, own, k, first=first, floor=floor)
                at = np.nonzero(scores > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[0]), row["q_part"])), pa.array(at[0]), pa.array(own[at[0]]), pa.array(found[at]), pa.array(scores[at].astype(np.int64))], ["q_part", "nth", "query_id", "id", "score"])

    def scored(some: DataFrame, floors: DataFrame | None) -> DataFrame:
        left = some.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets).cast("long"))).drop("part")
        right = chunks.select(F.col("part").alias("q_part"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q"), F.col("dims").alias("q_dims"))
        right = right.withColumn("floors", F.lit(None).cast("array<struct<nth: long, score: long>>")) if floors is None else right.join(floors, "q_part", "left")
        right = right.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
        # a merge, never a broadcast: Spark takes the copied queries for as small as their file
        pairs = left.join(right.hint("merge"), "bucket").select("ids", "matrix", "first", "dims", "q_part", "q_ids", "q", "q_dims", "floors")
        return pairs.mapInArrow(run, "q_part long, nth long, query_id long, id long, score long")

    rank = F.row_number().over(Window.partitionBy("q_part", "nth").orderBy(F.desc("score"), "id"))
    if n < 2 * FIRST:
        found = scored(shards, None)
    else:
        begin = saved(scored(shards.where(begun), None).withColumn("rank", rank).where(F.col("rank") <= k))
        floors = begin.where(F.col("rank") == k).groupBy("q_part").agg(F.collect_list(F.struct("nth", "score")).alias("floors"))  # of CHUNK queries at most
        found = begin.drop("rank").unionByName(scored(shards.where(~begun), saved(floors)))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
