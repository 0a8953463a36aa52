"""Near-duplicate documents: consistent weighted sampling of TF-IDF word shingles, banding, weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.mixing import row_hash
from tidemark.llm.shared import components, cut_without_loss, in_pieces, packed, per_worker, saved, small, whole_texts
from tidemark.llm.shingles import MIX1, MIX2, PRIME, scrambled, shingled

#: Similarity from which documents are near duplicates, bands and samples in a band.
SIMILAR, BANDS, ROWS = 0.8, 12, 3
#: Share of documents from which on a shingle's document frequency is counted; below it all shingles weigh alike, the most. It bounds the table of
#: counted shingles: at most (mean shingles of a document) / COMMON have that frequency.
COMMON = 1 / 1000
#: What idf adds to a shingle's weight of one, at most. Within a large group of copies the shared shingles are the common ones, so more would part the group.
IDF = 0.5
#: Shingles of a window in the search for common ones.
WINDOW = 500_000
#: Nodes of a list that meet all others of it before pairs are spelled out.
FIRSTS = 4
#: Pairs of one leader that a task verifies, about.
SHARE = 1000


def lowered(text: Column) -> Column:
    """A lower-cased text; null is empty."""
    return F.lower(F.coalesce(text, F.lit("")))


class Frequent:
    """Counts of shingles that may be held by a share of documents: lossy counting, by windows of so many shingles.

    Whatever at least that share of the documents so far hold is kept, counted short by half of that share of them at most. Of a window only that is kept for which this can be so.
    """

    def __init__(self, share: float, window: int):
        self.lost, self.window, self.docs, self.before, self.room = share / 2, window, 0, 0, window
        self.held: list[np.ndarray] = []
        self.h, self.n, self.short = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, h: np.ndarray) -> None:
        """Takes a document's distinct shingles."""
        self.held.append(h)
        self.docs += 1
        self.room -= len(h)
        if self.room <= 0:
            self.close()

    def close(self) -> None:
        """Merges the window's counts and drops what can't be frequent."""
        new, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.held]), return_counts=True)
        self.held, self.room = [], self.window
        h, at = np.unique(np.concatenate([self.h, new]), return_inverse=True)
        n, short = np.bincount(at, np.concatenate([self.n, count]), len(h)).astype(np.int64), np.full(len(h), int(self.lost * self.before))
        short[at[: len(self.h)]] = self.short
        keep = n + short > self.lost * self.docs
        self.h, self.n, self.short, self.before = h[keep], n[keep], short[keep], self.docs


def common_shingles(docs: DataFrame, text: Column, common: float = COMMON, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, idf from 0 to 1) of the shingles that at least that share of documents hold; all others have idf 1.

    Each task names what may be as frequent among its documents (see Frequent), counted short by half the share of them at most; so what all tasks together name for less than half the share isn't wanted, and the rest, a
    table of bounded size, is then counted exactly, over all documents. No table of all shingles is made.
    """
    texts = in_pieces(docs.select(lowered(text).alias("text")))
    n = docs.count()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Frequent(common, window)
        for batch in whole_texts(batches):
            for h, _ in shingled(batch.column(0)):
                found.add(h)
        found.close()
        yield pa.RecordBatch.from_arrays([pa.array(found.h.view(np.int64)), pa.array(found.n)], ["h", "n"])

    def packed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate([np.zeros(0, np.int64), *parts]) for parts in zip(*([c.to_numpy() for c in batch.columns] for batch in batches), strict=True)] or [np.zeros(0, np.int64)] * 2
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["k", "n"])

    def at_once(df: DataFrame) -> list[np.ndarray]:
        """Two columns of a bounded table."""
        row = df.coalesce(1).mapInArrow(packed_up, "k binary, n binary").first()
        return [np.frombuffer(c, np.int64) for c in row or (b"", b"")]  # an empty table may have no task

    found = texts.mapInArrow(name, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= common / 2 * n)
    wanted = np.sort(at_once(found)[0].view(np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted) + 1, np.int64)
        for batch in whole_texts(batches):
            for h, _ in shingled(batch.column(0)):
                at = np.searchsorted(wanted, h)
                total[at[wanted[np.minimum(at, len(wanted) - 1)] == h]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "n"])

    if not len(wanted):
        return wanted, np.zeros(0)
    df = np.zeros(len(wanted))
    at, counts = at_once(texts.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")))
    df[at] = counts
    keep = df >= common * n
    return wanted[keep], np.log(n / df[keep]) / np.log(1 / common)


def weigh(doc: tuple[np.ndarray, np.ndarray], table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, weights) of a document's shingles: how often one occurs times one plus a share of its idf: 1 for one in all documents, 1 + IDF for a rare one."""
    h, tf = doc
    weight = tf * (1 + IDF)
    if len(table[0]):
        at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        weight = np.where(table[0][at] == h, tf * (1 + IDF * table[1][at]), weight)
    return h, weight


def gamma_table(size: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of equal parts, by bisection."""
    u = (np.arange(size) + 0.5) / size
    low, high = np.zeros(size), np.full(size, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return high


class Sampler:
    """Improved consistent weighted sampling: documents share a sample with the probability of their weighted Jaccard similarity.

    For a shingle of weight w and each sample, r and c are gamma variables and beta is uniform, all by hash. With t = floor(log w / r + beta), the shingle of least
    log c - r * (t - beta + 1) is picked, together with t. Weights are in units of a rare shingle's, for which t = 0, so most shingles need two look-ups:
    a hash picks one of 65536 draws of (r, beta), and one of as many quantiles of c.
    """

    def __init__(self, samples: int = BANDS * ROWS):
        self.seeds = scrambled(np.arange(1, samples + 1, dtype=np.uint64) * PRIME)[:, None]
        order = np.random.default_rng(20240607).permutation(1 << 16)
        self.r, self.beta = gamma_table(), (order + 0.5) / (1 << 16)
        self.log_c, self.least = np.log(gamma_table()).astype(np.float32), (self.r * (1 - self.beta)).astype(np.float32)

    def part(self, h: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least value, pick) of each sample over a document's shingles or some of them."""
        x = (h[None, :] ^ self.seeds) * MIX1
        x ^= x >> np.uint64(32)
        x *= MIX2
        bits = x.view(np.uint16).reshape(*x.shape, 4)
        at = bits[..., 3]
        value = self.log_c[bits[..., 2]] - self.least[at]
        t = None
        other = np.flatnonzero(log_w)
        if len(other):
            r, beta = self.r[at[:, other]], self.beta[at[:, other]]
            t = np.zeros(x.shape, np.int64)
            t[:, other] = np.floor(log_w[other] / r + beta)
            value[:, other] = self.log_c[bits[:, other, 2]] - r * (t[:, other] - beta + 1)
        j, rows = value.argmin(1), np.arange(len(x))
        pick = h[j] if t is None else h[j] + t[rows, j].view(np.uint64) * PRIME
        return value[rows, j], pick

    def keys(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A key for each band: a hash of its samples. Long documents are sampled in parts."""
        log_w = np.log(weight / (1 + IDF))
        log_w[np.abs(log_w) < 1e-12] = 0
        least, picked = self.part(h[: 1 << 12], log_w[: 1 << 12])
        for i in range(1 << 12, len(h), 1 << 12):
            value, pick = self.part(h[i : i + (1 << 12)], log_w[i : i + (1 << 12)])
            picked = np.where(value < least, pick, picked)
            least = np.minimum(value, least)
        bands = picked.reshape(-1, ROWS)
        key = scrambled(np.arange(len(bands), dtype=np.uint64))
        for i in range(ROWS):
            key = scrambled(key * PRIME + bands[:, i])
        return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of the lesser weights of two documents, indices of b's shingles that weigh more there than in a, by how much)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    more = b[1].copy()
    more[j] -= a[1][i]
    at = np.flatnonzero(more > 1e-9)
    return float(np.minimum(a[1][i], b[1][j]).sum()), at, more[at]


def narrowed(posts: DataFrame, want: Callable) -> DataFrame:
    """posts without what can't decide a pair, by two sums over lists and nodes: no list is gathered, nothing is paired.

    A list (a, s) counts only if it holds nodes of two classes, one of them away from the leader. What a node can have in common with another over the leader is
    what it has in such lists (`over`); a node stays in a list only if that, with the list's other bounds, can be enough. `held` is the list's length, `need` the least that
    a pair over the leader asks of the list's node. Lists of the same nodes, such as those of a passage's shingles, become one with the sum of their weights: its name is a hash of its nodes.
    """
    posts = posts.drop("over", "held", "need")
    lists = posts.groupBy("a", "s").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.max("away").alias("any"), F.min("size").alias("lo"), F.max("common").alias("top"), F.count("*").alias("held"), F.bit_xor(F.xxhash64("b")).alias("name")).where("c1 <> c2 and any").drop("c1", "c2", "any")
    posts = posts.join(lists, ["a", "s"]).drop("s").withColumnRenamed("name", "s")
    posts = posts.groupBy([c for c in posts.columns if c != "w"]).agg(F.sum("w").alias("w"))
    over = F.sum("w").over(Window.partitionBy("a", "b"))
    posts = posts.withColumns({"over": over, "need": want(F.col("size"), F.col("lo")) - F.least("common", "top")})
    return posts.where("over >= need").drop("lo", "top")


def rarest(posts: DataFrame) -> DataFrame:
    """Of each node of narrowed posts the lists by which it must be found: its shortest ones.

    If two nodes are similar, what they share over the leader weighs at least the least need of either. So of a node's lists, the longest may go as long as what they weigh together is less: were all
    lists that two nodes share among those that either left, the one that leaves more of them would hold too little outside. Lists are in one order for all nodes, by length, then by name.
    `over` becomes what a list and the longer ones weigh: in the first list that two nodes share, it bounds what they share over the leader.
    """
    mine = Window.partitionBy("a", "b")
    longest = mine.orderBy(F.desc("held"), "s").rowsBetween(Window.unboundedPreceding, 0)
    return posts.withColumns({"need": F.min("need").over(mine), "over": F.sum("w").over(longest)}).where("over >= need - 1e-9").drop("need", "held")


def classes(buckets: DataFrame, meet: Callable[[DataFrame], DataFrame], similar: float) -> DataFrame:
    """(node, root) for nodes that are linked to others: root is the smallest node of the class.

    buckets: (key, node), a saved table; nodes that share a key are candidates. meet gives for pairs (a, b) their similarity `sim`, b's weight `size`, the overlap's weight `common`,
    and `added`, b's shingles s over a and by how much w. Each bucket's smallest node meets all others of its bucket. Then the bucket gets a leader, the hub of its
    best linked member, and all its nodes meet that: linear in its size, this settles groups of copies.

    A link is left only between nodes of one leader in different classes, one of which at least is away from the leader (in another class than it). Such a pair is
    similar only if the lesser of their overlaps with the leader is enough by itself, or if both hold the same shingle over the leader and that overlap with the lesser of what they
    share with others over the leader is enough. Nodes and lists that can't meet these bounds go by sums (see narrowed), in each list left some of the nodes that are away meet the others,
    which merges classes, and only the pairs that are then open are spelled out and verified. No link between candidates is lost.
    """
    want = lambda x, y: similar / (1 + similar) * (x + y) - 1e-9  # noqa: E731  the overlap of two similar documents
    lead = saved(buckets.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("key", "a"))
    if lead.isEmpty():  # no candidates
        return lead.select(F.col("a").alias("node"), F.col("a").alias("root"))
    tried = buckets.join(lead, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    met = saved(meet(saved(tried)))
    # a leader by chance tells little about its bucket: a node's hub is the leader similar to it that most others are similar to
    links = met.where(F.col("sim") >= similar).select("a", "b")
    held = links.groupBy("a").agg(F.count("*").alias("n"))
    near = links.join(held, "a").select(F.col("b").alias("node"), "a", "n").unionByName(held.select(F.col("a").alias("node"), "a", "n"))
    hubs = saved(near.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("rank"), F.col("a").alias("hub"))).alias("h")))
    best = buckets.join(lead.select("key"), "key").join(hubs, "node", "left")
    best = best.groupBy("key").agg(F.min(F.struct(F.coalesce("h.rank", F.lit(0)).alias("rank"), F.coalesce("h.hub", "node").alias("hub"))).alias("h")).select("key", F.col("h.hub").alias("a"))
    led = saved(buckets.join(best, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct())
    again = saved(led.join(met.select("a", "b"), ["a", "b"], "left_anti"))
    met = saved(met.join(led, ["a", "b"], "left_semi").unionByName(meet(again)))

    def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
        """roots with the classes that links join, as far as one step goes: each class takes the smallest root that it has a link to."""
        ends = more.select(F.col("a").alias("node")).union(more.select("b"))
        roots = saved(roots.unionByName(ends.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root")))
        name = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        across = more.join(name("a"), "a").join(name("b"), "b")
        low = across.select(F.col("ra").alias("root"), F.col("rb").alias("to")).union(across.select("rb", "ra")).groupBy("root").agg(F.min("to").alias("to"))
        return saved(roots.join(low, "root", "left").select("node", F.least("root", F.coalesce("to", "root")).alias("root")))

    def labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows (a, b) with b's class c, and whether that isn't its leader's."""
        rows = rows.join(roots.withColumnRenamed("node", "b").withColumnRenamed("root", "rb"), "b", "left").join(roots.withColumnRenamed("node", "a").withColumnRenamed("root", "ra"), "a", "left")
        return rows.withColumns({"c": F.coalesce("rb", "b"), "away": F.coalesce("rb", "b") != F.coalesce("ra", "a")}).drop("ra", "rb")

    def left(rows: DataFrame, posts: DataFrame, firsts: bool) -> DataFrame:
        """Pairs that may be similar; firsts: only those of FIRSTS nodes a list with others, of the nodes away from the leader the closest to it by parts."""
        whole = F.struct("b", "c", "size", "common", "over", "away")
        near = rows.where(F.col("common") >= similar * F.col("size") - 1e-9).withColumn("over", F.lit(0.0))
        # what lies within the leader is listed by size, so that the first node of a size meets those of that size and the next
        near = near.withColumn("s", F.explode(F.array(F.floor(F.log("size") * 8), F.floor(F.log("size") * 8) + 1)) if firsts else F.lit(0))

        def paired(lists: DataFrame) -> DataFrame:
            x = lists.where("away").groupBy("a", "s", F.pmod(F.xxhash64("b"), F.lit(FIRSTS))).agg(F.max_by(whole, F.struct("common", "b")).alias("x")) if firsts else lists.where("away").select("a", "s", whole.alias("x"))
            both = x.join(lists.select("a", "s", whole.alias("y")), ["a", "s"]).where("x.c <> y.c")
            return both.where(F.least("x.common", "y.common") + F.least("x.over", "y.over") >= want(F.col("x.size"), F.col("y.size"))).select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b"))

        pairs = paired(rarest(posts)).unionByName(paired(near)).distinct()
        return saved(pairs.join(seen, ["a", "b"], "left_anti"))

    links = links.unionByName(met.where(F.col("sim") >= similar).select("a", "b"))
    roots = saved(components(links))
    extra = []
    seen = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rows = saved(labelled(met, roots))
    # of leaders from whose class a node is away, all rows
    rows = rows.join(small(saved(rows.where("away").select("a").distinct())), "a", "left_semi")
    posts = rows.select("a", "b", "size", "common", "c", "away", F.explode("added").alias("p")).select("*", "p.s", "p.w").drop("p")
    for firsts in (True, False):
        posts = saved(narrowed(posts, want))
        pairs = left(rows, posts, firsts)
        if pairs.isEmpty():
            continue
        more = saved(meet(pairs).where(F.col("sim") >= similar).select("a", "b"))
        extra.append(more)
        if firsts:
            seen = seen.unionByName(pairs)
            classed = merged(roots, more)
            rows, posts = (labelled(df.drop("c", "away"), classed) for df in (rows, posts))
    whole = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    for more in extra:
        whole = whole.unionByName(more)
    return saved(components(whole)) if extra else roots


def hashed(text: Column) -> list[Column]:
    """128 bits that stand for a whole text; null is empty."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit("second"), whole).alias("t2")]


def classified(docs: DataFrame, doc_id: str, text: str, similar: float) -> DataFrame:
    """(id, t1, t2, node, root, class_id) of each row that has an id, a saved table: node is its text's number, root the least of its class, class_id the smallest id of that text.

    Texts are numbered in the order of their smallest ids, so the least number of a class has the smallest id of it.
    """
    body = F.col(f"`{text}`")
    known = docs.where(F.col(f"`{doc_id}`").isNotNull())
    table = common_shingles(known, body)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = per_worker(("sampler",), Sampler)
        for batch in whole_texts(batches):
            keys = np.concatenate([np.zeros(0, np.int64), *[sampler.keys(*weigh(doc, table)) for doc in shingled(batch.column(3))]])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["id", "t1", "t2", "keys"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = known.select(F.col(f"`{doc_id}`").alias("id"), *hashed(body), lowered(body).alias("text"))
    signed = saved(in_pieces(rows).mapInArrow(sign, f"id {kind}, t1 long, t2 long, keys array<long>"))
    nodes = signed.groupBy("t1", "t2").agg(F.min("id").alias("first"), F.first("keys").alias("keys"))
    nodes = saved(nodes.orderBy("first", "t1", "t2").withColumn("node", F.monotonically_increasing_id()))
    buckets = saved(nodes.select(F.explode("keys").alias("key"), "node"))

    def meet(pairs: DataFrame) -> DataFrame:
        """Verifies a saved table of pairs on their texts. A leader's pairs are dealt out to as many tasks as they need, its text going to each."""

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, x = None, None
            for batch in batches:
                numbers, lengths, s, w = [], [0], [np.zeros(0, np.uint64)], [np.zeros(0)]
                for a, one, doc in zip(batch.column(0), batch.column(2), shingled(batch.column(3)), strict=True):
                    if last is None or not last.equals(a):
                        last, x = a, weigh(next(shingled(pa.array([one.as_py()]))), table)
                    y = weigh(doc, table)
                    common, at, more = overlap(x, y)
                    size = float(y[1].sum())
                    numbers.append((common / (float(x[1].sum()) + size - common), size, common))
                    lengths.append(len(at))
                    s.append(y[0][at])
                    w.append(more)
                added = pa.StructArray.from_arrays([pa.array(np.concatenate(s).view(np.int64)), pa.array(np.concatenate(w))], ["s", "w"])
                added = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), added)
                columns = np.array(numbers, float).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, columns), added], ["a", "b", "sim", "size", "common", "added"])

        need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        need = saved(nodes.select("node", F.col("first").alias("id"), "t1", "t2").join(need, "node", "left_semi"))
        texts = known.select(F.col(f"`{doc_id}`").alias("id"), *hashed(body), lowered(body).alias("text")).join(small(need), ["id", "t1", "t2"])
        texts = saved(texts.groupBy("node").agg(F.min("text").alias("text")))
        hot = saved(pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares")).where("shares > 1"))  # a row for each SHARE pairs at most
        leaders = texts.select(F.col("node").alias("a"), F.col("text").alias("x")).join(hot, "a", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1)).cast("long") - 1)))
        dealt = pairs.join(hot, "a", "left").withColumn("share", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1)).cast("long")))
        both = dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").drop("shares").join(leaders.drop("shares"), ["a", "share"])
        return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long, sim double, size double, common double, added array<struct<s: long, w: double>>")

    roots = classes(buckets, meet, similar)
    roots = roots.join(nodes.select(F.col("node").alias("root"), F.col("first").alias("class_id")), "root")
    found = nodes.select("t1", "t2", "node", "first").join(roots, "node", "left")
    found = found.select("t1", "t2", "node", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "first").alias("class_id"))
    return saved(signed.select("id", "t1", "t2").join(found, ["t1", "t2"]))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id) for each row: class_id is the smallest doc_id among the texts that equal texts and links of near duplicates connect.

    Shingles of five lower-cased words are weighed by TF-IDF (see weigh); a candidate pair shares a band of ROWS samples, so of pairs at similarity 0.8 one in some
    5000 is missed; candidate pairs are verified on whole texts (see classes).

    A null text counts as empty; empty texts are equal. What is compared is texts: rows of one doc_id with different texts have a class each, and a repeated id links nothing.
    A row without doc_id has class null and links nothing. An empty table gives an empty one; other columns are left out. Ids may be of any type that can be ordered.

    Equal texts are one node from the start. Weights need counts of common shingles only, a table of bounded size that goes to all tasks.
    """
    found = classified(docs, doc_id, text, similar)
    without = docs.where(F.col(f"`{doc_id}`").isNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{doc_id}`").alias("class_id"))
    return found.select(F.col("id").alias("doc_id"), "class_id").unionByName(without)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each class: of its texts that with the smallest doc_id (of several texts of this id, one), and of that text the row of this id; of rows equal in both, the first by hash.

    A text that resembles no other stays, whatever other texts its id has. Rows without doc_id all stay.
    """
    found = classified(docs, doc_id, text, similar)
    id, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    rows = docs.select(packed(docs).alias("row"), id.alias("id"), *[F.when(id.isNotNull(), t).alias(name) for t, name in zip(hashed(body), ("t1", "t2"))], row_hash(docs).alias("hash"))
    kept = cut_without_loss(rows, saved(found.where("node <> root or id <> class_id").select("id", "t1", "t2")), ["id", "t1", "t2"])
    stays = found.where("node = root and id = class_id")
    if stays.groupBy("id", "t1", "t2").count().where("count > 1").isEmpty():
        return kept.select("row.*")
    one = kept.where("id is not null").groupBy("id", "t1", "t2").agg(F.min_by("row", "hash").alias("row"))
    return one.select("row").unionByName(kept.where("id is null").select("row")).select("row.*")
