"""Shards of the hash tree."""

import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm.queries import QUERIES
from tidemark.llm.sharding import assign_shards, tree


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = assign_shards(spark.range(20_000).withColumnRenamed("id", "doc_id"), [1.0] * 8, grown=[1.0] * 9).collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) < 1.15 * min(counts.values())
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {8} and abs(len(moved) / 20_000 - 1 / 9) < 0.01
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_confined_movement(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    rows = assign_shards(ids, [1, 1, 1, 1, 2, 1, 1, 1, 1], grown=[1, 1, 1, 1, 2, 1, 1, 1, 0]).collect()
    counts = Counter(r.shard for r in rows)
    assert abs(counts[4] / 20_000 - 2 / 10) < 0.01 and all(abs(counts[i] / 20_000 - 1 / 10) < 0.01 for i in range(9) if i != 4)
    # shard 8, a region of its own, goes: its keys move to all others, no other key does
    assert not any(r.grown_shard == 8 for r in rows)
    assert all(r.grown_shard == r.shard for r in rows if r.shard != 8)
    # shard 5 (region 1, rack 0) gains weight: keys enter region 1; within it only its rack gains; no key passes between the other regions or the racks that stay
    rows = assign_shards(ids, [1.0] * 10, grown=[1.0] * 5 + [3.0] + [1.0] * 4).collect()
    place = {i: (r, k) for r, racks in enumerate(tree([1.0] * 10)) for k, rack in enumerate(racks) for i in rack}
    for r in rows:
        old, new = place[r.shard], place[r.grown_shard]
        if r.shard != r.grown_shard:
            assert new[0] == 1 and (old[0] != 1 or new == (1, 0))
    assert abs(Counter(r.grown_shard for r in rows)[5] / 20_000 - 3 / 12) < 0.015


def test_one_more_takes_rows_only_into_itself_for_any_count(spark):
    ids = spark.range(4_000).withColumnRenamed("id", "doc_id")
    for n in (8, 9, 10, 11, 12, 17):
        rows = assign_shards(ids, [1.0] * n, grown=[1.0] * (n + 1)).collect()
        moved = {r.grown_shard for r in rows if r.shard != r.grown_shard}
        assert moved == {n} and abs(sum(r.shard != r.grown_shard for r in rows) / 4_000 - 1 / (n + 1)) < 0.03, n
    for n in (1, 2, 3):
        rows = assign_shards(ids, [1.0] * n, grown=[1.0] * (n + 1), founded=1).collect()
        assert {r.grown_shard for r in rows if r.shard != r.grown_shard} == {n}


def test_equals_a_plain_descent_of_the_tree_and_no_flat_draw(spark):
    """Region, rack and shard drawn for one by one; a draw over all shards at once would give others."""
    weights = [1.0, 2.0, 0.5, 1.0, 0.0, 3.0, 1.0, 1.0, 2.0]
    regions = tree(weights)
    assert regions == [[[0, 1], [2, 3]], [[4, 5], [6, 7]], [[8]]]
    paths = [f"/{r}" for r in range(3)] + [f"/{r}/{k}" for r in range(3) for k in range(2)] + [f"/{r}/{k}/{s}" for r in range(3) for k in range(2) for s in range(2)]
    ids = spark.range(2_000).withColumnRenamed("id", "doc_id")
    hashes = ids.select("doc_id", *[F.xxhash64(F.lit(p), "doc_id").alias(p) for p in paths]).collect()

    def total(node):
        return weights[node] if isinstance(node, int) else sum(map(total, node))

    def draw(row, path, weight):
        return -math.log((((row[path] & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53)) / weight if weight else math.inf

    want, flat = {}, {}
    for row in hashes:
        path, node = "", regions
        while not isinstance(node, int):
            i = min(range(len(node)), key=lambda i: draw(row, f"{path}/{i}", total(node[i])))
            path, node = f"{path}/{i}", node[i]
        want[row.doc_id] = node, *(int(x) for x in path.split("/")[1:3])
        leaves = {i: f"/{r}/{k}/{s}" for r, racks in enumerate(regions) for k, rack in enumerate(racks) for s, i in enumerate(rack)}
        flat[row.doc_id] = min(leaves, key=lambda i: draw(row, leaves[i], weights[i]))
    got = {r.doc_id: (r.shard, r.region, r["rack"]) for r in assign_shards(ids, weights).collect()}
    assert got == want
    assert sum(flat[k] != v[0] for k, v in got.items()) > 1_000


def test_messy_rows(messy, empty):
    rows = assign_shards(messy, [1.0] * 8, tie=F.xxhash64("text")).collect()
    assert len(rows) == messy.count()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())
    assert assign_shards(empty, [1.0] * 8).collect() == []


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_sharding"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "key" for r in rows)
