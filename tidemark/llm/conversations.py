"""Repair of conversations: the cheapest edits that make the turns of a conversation alternate, found by an auction over a lattice of rows and roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BLANKS, cut_without_loss, saved, small

#: Rows up to which a conversation is repaired in one piece, and items of a block of a longer one.
PIECE = 256

#: Layers that an auction's path crosses at most until it meets prices that have converged.
STEP = 8

#: The price of a node from which there is no way out.
NEVER = 1 << 60

# Costs of the edits.
KEEP, REROLE, INSERT, TRUNCATED, DELETE = 0, 3, 3, 3, 4

#: Kinds of a row: sound, truncated, or one that must go.
SOUND, CUT, DEAD = 0, 1, 2

#: Places in `(s?(ua)+)?`: nothing yet, after s, after u, after a; and the roles of inserted or changed rows that lead to the latter two.
BEGUN, AFTER_S, AFTER_U, AFTER_A = range(4)
ROLES = {AFTER_U: "user", AFTER_A: "assistant"}

#: What it costs to end in a place, and the edits that do.
ENDS = (0, 2 * INSERT, INSERT, 0)
TAILS = ("", "II", "I", "")

Arcs = list[list[tuple[int, int, object]]]


def following(place: int) -> int:
    """The place after a row of the role that may come next, user or assistant."""
    return AFTER_A if place == AFTER_U else AFTER_U


@cache
def row_arcs(initial: str, kind: int) -> Arcs:
    """From each place the cheapest ways over a row, as (place, cost, edits): inserts, then one edit of the row; of equal ones the least edits."""
    arcs: Arcs = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        place, cost, edits = start, 0, ""
        for _ in range(3):
            ways = [(place, DELETE, "D")]
            if kind != DEAD:
                more = TRUNCATED if kind == CUT else 0
                ways.append((following(place), REROLE + more, "R"))
                if initial == "s" and place == BEGUN:
                    ways.append((AFTER_S, KEEP + more, "K"))
                elif initial == "ua"[place == AFTER_U]:
                    ways.append((following(place), KEEP + more, "K"))
            for end, price, letter in ways:
                best[end] = min(best.get(end, (NEVER, "")), (cost + price, edits + letter))
            place, cost, edits = following(place), cost + INSERT, edits + "I"
        arcs.append([(end, *found) for end, found in best.items()])
    return arcs


def copies_arcs(n: int) -> Arcs:
    """n rows that must go."""
    return [[(place, DELETE * n, "D" * n)] for place in range(4)]


class Auction:
    """Shortest paths over layers of arcs between the four places, by the auction algorithm.

    A node's price never exceeds the cheapest arc's cost plus the price at its end. A path starts at an origin; at its last node it is extended by the cheapest arc if the
    price equals that sum, else the price rises to it and the path gives the node up. Origins are the four places of every STEP-th layer, from the last layers to the first; a path ends
    where it meets prices that have converged, so each auction crosses few layers. Then arcs of reduced cost zero that lead on to such nodes hold all shortest paths.
    """

    def __init__(self, layers: list[Arcs], exits: Iterable[int], step: int = STEP):
        self.layers = layers
        n = len(layers)
        self.price = [[0] * 4 for _ in range(n)] + [list(exits)]
        self.alive = [[False] * 4 for _ in range(n)] + [[p < NEVER for p in self.price[n]]]
        end = n
        while end > 0:
            start = max(0, end - step)
            for place in range(4):
                self.bid(start, place, end)
            for i in range(end - 1, start - 1, -1):
                self.alive[i] = [bool(self.tight(i, place)) for place in range(4)]
            end = start

    def bid(self, start: int, place: int, end: int) -> None:
        """One auction from an origin to the layer `end`."""
        path, price, layers = [place], self.price, self.layers
        while len(path) <= end - start:
            i, at = start + len(path) - 1, path[-1]
            beyond = price[i + 1]
            least, to = NEVER, -1
            for t, cost, _ in layers[i][at]:
                if cost + beyond[t] < least:
                    least, to = cost + beyond[t], t
            if price[i][at] < least:
                price[i][at] = least
                if len(path) > 1:
                    path.pop()
            elif to < 0:
                return
            else:
                path.append(to)

    def tight(self, i: int, place: int) -> list[tuple[int, int, object]]:
        """The arcs of reduced cost zero that lead on."""
        price, beyond, alive = self.price[i][place], self.price[i + 1], self.alive[i + 1]
        return [arc for arc in self.layers[i][place] if alive[arc[0]] and arc[1] + beyond[arc[0]] == price]

    def trace(self, place: int) -> tuple[list[int], list]:
        """The places of the shortest path from a place of the first layer, and its arcs' labels, the least at every step."""
        places, labels = [place], []
        for i in range(len(self.layers)):
            place, _, label = min(self.tight(i, place), key=lambda arc: arc[2])
            places.append(place)
            labels.append(label)
        return places, labels


def item_layers(initials: Iterable[str], kinds: Iterable[int], copies: Iterable[int]) -> list[Arcs]:
    """Two layers for an item: its first row, and the copies beside it, which must go."""
    return [arcs for initial, kind, n in zip(initials, kinds, copies) for arcs in ([row_arcs(initial, kind), copies_arcs(n - 1)] if n > 1 else [row_arcs(initial, kind)])]


def emitted(places: list[int], labels: list[str], copies: list[int]) -> Iterator[tuple[int | None, str | None]]:
    """The rows of the repaired conversation as (item, role): None for an inserted row, and for the role that the item has."""
    place, step = places[0], 0
    for item, n in enumerate(copies):
        for letter in labels[step]:
            if letter == "I":
                place = following(place)
                yield None, ROLES[place]
            elif letter == "R":
                yield item, ROLES[places[step + 1]]
            elif letter == "K":
                yield item, None
        step += 2 if n > 1 else 1
        place = places[step]


def tail(place: int) -> list[str]:
    """Roles of the rows inserted at the end."""
    roles = []
    for _ in TAILS[place]:
        place = following(place)
        roles.append(ROLES[place])
    return roles


def unlawful(initials: list[str], copies: list[int]) -> int:
    """Neighbours whose initials may not stand side by side."""
    return sum(n - 1 for n in copies) + sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_one(rows: list[tuple]) -> tuple:
    """Counts, cost, audit and digest of a conversation's rows (turn, role, text as bytes, kind, copies), in order."""
    rows = [r for r in rows if r[4] > 0]
    seen: set[tuple] = set()
    initials, kinds, copies = [r[1][:1] for r in rows], [], [r[4] for r in rows]
    blank = duplicate = truncated = 0
    for _, role, text, kind, n in rows:
        again = (role, text) in seen
        seen.add((role, text))
        if kind == DEAD:
            blank += n
        else:
            duplicate += n - 1 + again
            truncated += kind == CUT and not again
        kinds.append(DEAD if again else kind)
    turns = {r[0] for r in rows if r[0] is not None}
    found = Auction(item_layers(initials, kinds, copies), ENDS)
    places, labels = found.trace(BEGUN)
    digest, first = hashlib.sha256(), True
    for item, role in [*emitted(places, labels, copies), *((None, role) for role in tail(places[-1]))]:
        if not first:
            digest.update(b"\n")
        first = False
        digest.update((rows[item][1] if role is None else role).encode() + b":" + (b"" if item is None else rows[item][2]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, blank, duplicate, truncated, unlawful(initials, copies), found.price[0][BEGUN], "".join(labels) + TAILS[places[-1]], digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text, n): rows after damage, n times each (0: dropped), nulls but those of ids and turns read as one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("damage"), shown("role").alias("role"), shown("text").alias("text"))
    damage = F.col("damage")
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("~")).alias("key"), "conv_id", "turn", F.when(damage == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(damage.isin(0, 1), "").when(damage == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def kind_of(text: Column) -> Column:
    """DEAD for blank text, CUT for text that doesn't end a sentence."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", DEAD).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)


#: The order of a conversation's rows; Spark sorts nulls first.
ORDER = ["turn", "role", "digest"]


def repair_conversations(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text), which are damaged first: counts of faults, the cheapest edits (audit), their cost, and the digest of the repaired conversation.

    Rows are read by turn (null turns first), those of one turn by role, then by the MD5 of their text; equal rows stand side by side, and all but the first are duplicates. Rows without
    conv_id are a conversation of their own. Null role and text are one space: such a role's row can't be kept as it is, such a text is blank. Empty texts are blank, very long ones read
    whole. Other columns, whatever their names, are not read; an empty table gives no rows; a conversation without rows after damage has zeros, an empty audit and the digest of nothing.

    A conversation of up to `piece` rows is repaired in the task that gets it, row by row from sorted partitions. A longer one is cut: its rows are ranged by turn over all tasks, so that
    none gets the whole of it, and every block of up to `piece` items (equal rows are one) is crossed by auctions from each place to each; the blocks' costs are the arcs of a second
    lattice, with a row a block, whose path tells each block where to begin and end. The digest is a chain over the whole conversation by its definition: one task reads the blocks' texts
    in order and holds none of them. Both forms give the same rows for any `piece`.
    """
    rows = damaged(conversations)
    sizes = rows.groupBy("key").agg(F.sum("n").alias("rows"))
    long = saved(sizes.where(F.col("rows") > piece).select("key"))
    brief = pieces(cut_without_loss(rows, long, ["key"]))
    return brief if long.isEmpty() else brief.unionByName(long_ones(rows.where("n > 0").join(small(long), "key", "left_semi"), piece))


def pieces(rows: DataFrame) -> DataFrame:
    """Repairs of conversations that fit in a task."""
    fields = [("conv_id", rows.schema["conv_id"].dataType.simpleString()), *[(c, "long") for c in COUNTS], ("audit", "string"), ("repaired_sha256", "string")]
    rows = rows.withColumn("digest", F.md5("text")).repartition("key").sortWithinPartitions("key", *ORDER)
    rows = rows.select("key", "conv_id", "turn", "role", F.col("text").cast("binary").alias("text"), kind_of(F.col("text")).alias("kind"), "n")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, kind = None, [], None

        def closed(done: list) -> pa.RecordBatch:
            ids, found = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(x, pa.int64() if i < len(COUNTS) else pa.string()) for i, x in enumerate(zip(*found))]], names=[f for f, _ in fields])

        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            for k, conv, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and k != key:
                    done.append((last, repair_one(held)))
                    held = []
                key, last = k, conv
                held.append(tuple(row))
            if done:
                yield closed(done)
        if held:
            yield closed([(last, repair_one(held))])

    return rows.mapInArrow(repaired, ", ".join(f"{c} {t}" for c, t in fields))


def long_ones(rows: DataFrame, piece: int) -> DataFrame:
    """Repairs of conversations that are spread over tasks."""
    from pyspark import TaskContext

    rows = rows.withColumn("digest", F.md5("text"))
    items = rows.groupBy("key", *ORDER).agg(F.sum("n").alias("n"), F.min(kind_of(F.col("text"))).alias("kind"))
    items = saved(items)
    when = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = items.where(F.col("kind") != DEAD).groupBy("key", "role", "digest").agg(F.min(when).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    again = F.coalesce(F.col("first") != when, F.lit(False))
    items = items.join(firsts, ["key", "role", "digest"], "left").select("key", *ORDER, "n", "kind", again.alias("again"))
    ranged = items.repartitionByRange("key", *ORDER).sortWithinPartitions("key", *ORDER)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of neighbours; their numbers grow along a conversation."""
        number, rest = TaskContext.get().partitionId() << 32, None

        def block(part: pd.DataFrame) -> dict:
            return {"key": part["key"].iloc[0], **{c: part[c].tolist() for c in ("turn", "role", "digest", "n", "kind", "again")}}

        for frame in frames:
            frame = frame.astype({"turn": "Int64"})
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            out, at = [], 0
            starts = rest.index[rest["key"] != rest["key"].shift()].tolist() + [len(rest)]
            for a, b in zip(starts, starts[1:]):
                while b - a >= piece or b < len(rest):
                    end = min(a + piece, b)
                    out.append(block(rest.iloc[a:end]) | {"block": number})
                    number, a = number + 1, end
                    if a >= b:
                        break
                at = a
            rest = rest.iloc[at:].reset_index(drop=True)
            if out:
                yield blocks_frame(out)
        if rest is not None and len(rest):
            yield blocks_frame([block(rest) | {"block": number}])

    def blocks_frame(out: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame(out)
        frame["turn"] = [[None if t is pd.NA else int(t) for t in x] for x in frame["turn"]]
        return frame[["key", "block", "turn", "role", "digest", "n", "kind", "again"]]

    blocks = saved(ranged.mapInPandas(cut, "key string, block long, turn array<long>, role array<string>, digest array<string>, n array<long>, kind array<int>, again array<boolean>"))

    def layers_of(row) -> tuple[list[str], list[int], list[Arcs]]:
        copies = [int(n) for n in row.n]
        initials = [r[:1] for r in row.role]
        return initials, copies, item_layers(initials, [DEAD if a else int(k) for k, a in zip(row.kind, row.again)], copies)

    def crossed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each block as an arc from each place to each: its cost, and its rank among the edits from that place."""
        for frame in frames:
            out = []
            for row in frame.itertuples():
                initials, copies, layers = layers_of(row)
                costs, edits = [[0] * 4 for _ in range(4)], [[""] * 4 for _ in range(4)]
                for to in range(4):
                    found = Auction(layers, [0 if p == to else NEVER for p in range(4)])
                    for start in range(4):
                        costs[start][to] = found.price[0][start]
                        if costs[start][to] < NEVER:
                            edits[start][to] = "".join(found.trace(start)[1])
                ranks = [sorted(range(4), key=lambda p: e[p]) for e in edits]
                kinds = list(zip(row.kind, row.again, copies))
                out.append((
                    row.key, row.block, sum(costs, []), [r.index(p) for r in ranks for p in range(4)], initials[0], initials[-1], unlawful(initials, copies),
                    sum(n for k, _, n in kinds if k == DEAD), sum(n - 1 + bool(a) for k, a, n in kinds if k != DEAD), sum(k == CUT and not a for k, a, _ in kinds),
                ))
            yield pd.DataFrame(out, columns=["key", "block", "costs", "ranks", "head", "foot", "illegal", "blank", "duplicate", "truncated"])

    arcs = blocks.mapInPandas(crossed, "key string, block long, costs array<long>, ranks array<int>, head string, foot string, illegal long, blank long, duplicate long, truncated long")

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Where each block begins and ends; a conversation's sums stand beside its last block."""
        held: list = []

        def closed() -> pd.DataFrame:
            lattice = [[[(to, int(r.costs[4 * p + to]), int(r.ranks[4 * p + to])) for to in range(4) if r.costs[4 * p + to] < NEVER] for p in range(4)] for r in held]
            found = Auction(lattice, ENDS)
            places, _ = found.trace(BEGUN)
            illegal = sum(r.illegal for r in held) + sum(a.foot + b.head not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
            out = pd.DataFrame({"key": held[0].key, "block": [r.block for r in held], "start": places[:-1], "stop": places[1:]})
            out["last"] = [False] * (len(held) - 1) + [True]
            for name, value in (("cost", found.price[0][BEGUN]), ("illegal", illegal), *((c, sum(getattr(r, c) for r in held)) for c in ("blank", "duplicate", "truncated"))):
                out[name] = value
            return out

        for frame in frames:
            for row in frame.itertuples():
                if held and held[0].key != row.key:
                    yield closed()
                    held = []
                held.append(row)
        if held:
            yield closed()

    paths = arcs.repartition("key").sortWithinPartitions("key", "block").mapInPandas(joined, "key string, block long, start int, stop int, last boolean, cost long, illegal long, blank long, duplicate long, truncated long")
    paths = saved(paths)

    def rebuilt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of the repaired conversation; a block's edits stand in a row before them."""
        for frame in frames:
            out = []
            for row in frame.itertuples():
                _, copies, layers = layers_of(row)
                places, labels = Auction(layers, [0 if p == row.stop else NEVER for p in range(4)]).trace(row.start)
                out.append((row.key, row.block, -1, "".join(labels) + (TAILS[row.stop] if row.last else ""), None, None, None, False))
                after = [(None, role) for role in tail(row.stop)] if row.last else []
                for seq, (item, role) in enumerate([*emitted(places, labels, copies), *after]):
                    own = (None, None, None, False) if item is None else (row.turn[item], row.role[item], row.digest[item], True)
                    out.append((row.key, row.block, seq, own[1] if role is None else role, *own))
            frame = pd.DataFrame(out, columns=["key", "block", "seq", "shown", "turn", "role", "digest", "text_of"])
            yield frame.astype({"turn": "Int64"})

    chosen = blocks.join(paths.select("key", "block", "start", "stop", "last"), ["key", "block"])
    chosen = saved(chosen.mapInPandas(rebuilt, "key string, block long, seq int, shown string, turn long, role string, digest string, text_of boolean"))
    texts = rows.groupBy("key", *ORDER).agg(F.first("text").alias("text")).withColumnsRenamed({c: f"_{c}" for c in ("key", *ORDER)})
    same = (F.col("key") == F.col("_key")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    own = chosen.where("text_of").join(texts, same).select("key", "block", "seq", "shown", "text")
    rest = chosen.where("not text_of").select("key", "block", "seq", "shown", F.lit("").alias("text"))
    lines = F.transform(F.filter("rows", lambda x: x["seq"] >= 0), lambda x: F.concat(x["shown"], F.lit(":"), x["text"]))
    blocks_out = own.unionByName(rest).groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "shown", "text"))).alias("rows"))
    blocks_out = blocks_out.select("key", "block", F.get("rows", F.lit(0))["shown"].alias("edits"), F.when(F.size("rows") > 1, F.array_join(lines, "\n")).cast("binary").alias("lines"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Audit and digest of each conversation, block after block."""
        key, edits, digest, any_line = None, [], hashlib.sha256(), False

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array(["".join(edits)]), pa.array([digest.hexdigest()])], names=["key", "audit", "repaired_sha256"])

        for batch in batches:
            for k, e, line in zip(*[batch[c].to_pylist() for c in ("key", "edits", "lines")]):
                if k != key:
                    if key is not None:
                        yield closed()
                    key, edits, digest, any_line = k, [], hashlib.sha256(), False
                edits.append(e)
                if line is not None:
                    digest.update(b"\n" + line if any_line else line)
                    any_line = True
        if key is not None:
            yield closed()

    ends = blocks_out.repartition("key").sortWithinPartitions("key", "block").mapInArrow(chained, "key string, audit string, repaired_sha256 string")
    spans = items.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    ids = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    totals = paths.where("last").select("key", "blank", "duplicate", "truncated", "illegal", "cost")
    return ends.join(totals, "key").join(spans, "key").join(ids, "key").select("conv_id", *COUNTS, "audit", "repaired_sha256")
