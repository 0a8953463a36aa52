"""Shards by a tree of weighted hash draws: region, rack, shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import chunks_for, packed, running_totals, saved

#: Shards in a rack and racks in a region.
RACK, REGION = 2, 2

#: Shards that the tree was founded with: they fill regions; every later one opens a region of its own.
FOUNDED = 8


def tree(weights: list[float], founded: int = FOUNDED, rack: int = RACK, region: int = REGION) -> list[list[list[int]]]:
    """Regions of racks of shards, which are numbered from 0 in the order they were added.

    A later shard in a region of its own leaves all other weights as they are. Were it put into a region that is there, keys would be drawn to the grown region, and there into the
    old racks too; so the law of `assign_shards` would not hold.
    """
    first = range(min(founded, len(weights)))
    racks = [list(first[i : i + rack]) for i in range(0, len(first), rack)]
    return [racks[i : i + region] for i in range(0, len(racks), region)] + [[[i]] for i in range(founded, len(weights))]


def draw(path: Column, key: Column, weight: Column) -> Column:
    """-ln(u) / weight, u being a hash of key and path; null without weight. Of such draws each is the least in proportion to its weight."""
    u = (F.shiftrightunsigned(F.xxhash64(path, key), 11).cast("double") + 0.5) / float(1 << 53)
    return F.when(weight > 0, -F.log(u) / weight)


def winner(draws: list[Column]) -> Column:
    """The place of the least draw."""
    found = [F.when(d.isNotNull(), F.struct(d.alias("draw"), F.lit(i).alias("at"))) for i, d in enumerate(draws)]
    return (F.least(*found) if len(found) > 1 else found[0])["at"]


def descended(rows: DataFrame, key: Column, weights: list[float], names: tuple[str, str, str], founded: int = FOUNDED) -> DataFrame:
    """rows with region, rack (in its region) and shard (int, under the given names) that a key reaches.

    At each level the child of least draw is taken, a child's weight being the sum of its shards', and only the children of the node that was reached are drawn for: a row costs as many hashes as there
    are regions, racks in a region and shards in a rack. Draws of a level say nothing of the next one's.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("a shard must have a weight above zero")
    regions = tree(weights, founded)
    total = lambda node: float(max(weights[node], 0)) if isinstance(node, int) else sum(map(total, node))
    text = lambda c: F.col(c).cast("string")
    region, rack, shard = names
    racks, shards = max(map(len, regions)), max(len(r) for node in regions for r in node)
    child = lambda node, i: node[i] if i < len(node) else []
    at = lambda values, place: F.get(F.array(*map(F.lit, values)), place)
    rows = rows.withColumn(region, winner([draw(F.lit(f"/{i}"), key, F.lit(total(node))) for i, node in enumerate(regions)]).cast("int"))
    path = F.concat(F.lit("/"), text(region), F.lit("/"))
    rows = rows.withColumn(rack, winner([draw(F.concat(path, F.lit(str(i))), key, at([total(child(node, i)) for node in regions], F.col(region))) for i in range(racks)]).cast("int"))
    path, place = F.concat(path, text(rack), F.lit("/")), F.col(region) * racks + F.col(rack)
    below = [child(node, i) for node in regions for i in range(racks)]
    last = winner([draw(F.concat(path, F.lit(str(i))), key, at([total(child(node, i)) for node in below], place)) for i in range(shards)])
    return rows.withColumn(shard, at([child(node, i) if i < len(node) else -1 for node in below for i in range(shards)], place * shards + last).cast("int"))


def assign_shards(df: DataFrame, weights: list[float], key: str = "doc_id", grown: list[float] | None = None, tie: Column | None = None, founded: int = FOUNDED) -> DataFrame:
    """df with region, rack and shard (int), slot (long, gapless from 0 in its shard, by a hash of the key) and, if grown gives a later list of weights, grown_shard.

    The key and the weights alone decide: equal keys share a shard, a null key counts as a key of its own. Where a list of `founded` shards or more gets one more, keys move to that
    shard only. Where a weight changes, keys move into or out of that shard's region, within it into or out of its rack, and between the racks and shards of what has changed; regions whose weights stay exchange
    none. One that goes gives its keys up by weight. At least one weight must be above zero. Repeated rows get slots of their own; tie orders rows of one key. region, rack, shard,
    slot and grown_shard replace columns of these names.

    Slots take no sort of a whole shard: rows are counted by chunks of the hash, and each chunk is ordered by itself.
    """
    k = F.col("row").getField(key)
    rows = df.select(packed(df).alias("row"), (F.lit(0) if tie is None else tie).alias("tie"))
    rows = descended(rows, k, weights, ("region", "rack", "shard"), founded)
    rows = descended(rows, k, grown, ("_region", "_rack", "grown_shard"), founded) if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = saved(rows.select("row", "tie", "region", "rack", "shard", "grown_shard", F.xxhash64(F.lit("slot"), k).alias("h")))
    chunks = chunks_for(rows.count())
    rows = rows.withColumn("chunk", F.shiftrightunsigned("h", 44) % chunks)
    rows = running_totals(rows, ["shard"], "chunk", ["h", k, "tie"], F.lit(1), "slot")
    ours = ("region", "rack", "shard", "slot", "grown_shard")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in ours], "region", "rack", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
