"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import chunks_for, packed, running_totals, saved, small

WEIGHTS, SHARE, CAP, BLOCK = (3, 1, 2), 1.5, 2, 1024
#: The golden ratio's fractional part in units of 2 ** -31, rounded to an odd number: its multiples visit every point once.
GOLDEN, BITS = 1327217885, 31


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """A row per source: key, source, source_size, target, take (target in whole words).

    Sources in order of code points, null last, take the weights in turn and share `share` times all words by weight. A target
    stops at cap times its source's words; the excess is shared out again by weight. In order of words per weight the sources that
    stop come first, so running sums over that order give the level at which none is above. This is one row per source, not per document.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    per = saved(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))).withColumn("w", turn)
    order = [F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()]
    ahead = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(whole) - F.lit(cap) * F.coalesce(F.sum("source_size").over(ahead), F.lit(0))
    per = per.withColumns({"left": left, "over": F.sum("w").over(rest), "nth": F.row_number().over(Window.orderBy(*order))})
    per = per.withColumn("full", F.col("left") * F.col("w") / F.col("over") > F.lit(cap) * F.col("source_size"))
    level = F.min(F.when(~F.col("full"), F.struct("nth", "left", "over"))).over(whole)
    per = per.withColumn("level", level)
    target = F.when(F.col("level").isNull() | (F.col("nth") < F.col("level.nth")), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(F.col("level.left") * F.col("w") / F.col("level.over"))
    return saved(per.select("key", "source", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("take")))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, key, block): which source's which block stands at each slot of the mix.

    Slot i's point, the fraction of i times the golden ratio, falls into a source's share of the unit interval; the rank of a slot
    among its source's is the block it takes. A source that has had its blocks leaves further slots empty; one still short of a few
    after the last slot gets them at the end. Points meet shares by an equi-join on cells of a grid that is as fine as the sources are many.
    """
    spark = sources.sparkSession
    so_far = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    parts = sources.withColumn("blocks", F.ceil(F.col("take") / block)).where("blocks > 0").withColumn("hi", F.sum("blocks").over(so_far))
    parts = saved(parts.select("key", "blocks", "hi"))
    n, total = parts.agg(F.count("*"), F.coalesce(F.max("hi"), F.lit(0))).first()
    cell = BITS - min(20, n.bit_length() + 2)
    one = float(1 << BITS)
    spans = parts.select("key", "blocks", F.floor((F.col("hi") - F.col("blocks")) / F.lit(total) * one).alias("lo"), F.floor(F.col("hi") / F.lit(total) * one).alias("hi")).where("lo < hi")
    cells = small(saved(spans.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", cell), F.shiftright(F.col("hi") - 1, cell))))))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(1 << BITS)) * GOLDEN, F.lit(1 << BITS)).alias("p"))
    slots = slots.withColumn("cell", F.shiftright("p", cell)).join(cells, "cell").where("lo <= p and p < hi")
    slots = saved(slots.select("slot", "key", "blocks", F.floor(F.col("slot") / max(1, min(65536, total // 64))).alias("chunk")))
    ranked = running_totals(slots, ["key"], "chunk", ["slot"], F.lit(1), "block")
    had = slots.groupBy("key").agg(F.count("*").alias("had"))
    short = parts.join(had, "key", "left").where(F.coalesce("had", F.lit(0)) < F.col("blocks"))
    short = short.select("key", F.explode(F.sequence(F.coalesce("had", F.lit(0)), F.col("blocks") - 1)).alias("block"))
    return ranked.where("block < blocks").select("slot", "key", "block").unionByName(short.select((F.lit(total) + F.col("block")).alias("slot"), "key", "block"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans) of the mix.

    rows: a row per document: doc_id, source, size, source_size, target, taken (words, repeats counted), slots (in how many slots of the mix words of it stand, repeats counted), first_slot (the first, null if none), row_hash,
    start (of its words in its source's stream).
    spans: the mix itself: slot, source, doc_id, row_hash, start, pass_no, from_word, to_word (of the document's words; the end is exclusive).

    Each source's documents, shuffled by a hash of their ids, form a stream of words that is read at most cap times and cut into
    blocks of equal length; the schedule says which slot takes which block, and the last block ends at the target. So each source gives
    its target in whole words, and no document more than cap times its size. The same rows give the same mix.

    A null text has no words; such documents take no part but are in rows. A null source is a source of its own, a null or repeated
    doc_id is a document like any other. An empty table gives empty tables. Other columns count for row_hash only.
    """
    name = F.col(f"`{source}`").cast("string")
    sized = saved(docs.select(F.col(f"`{doc_id}`").alias("id"), name.alias("source"), F.coalesce(F.concat(F.lit("="), name), F.lit("~")).alias("key"), word_count(F.col(f"`{text}`")).alias("size"), F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")).alias("h"), row_hash(docs).alias("row_hash")))
    sources = source_targets(sized, weights, share, cap)
    chunks = chunks_for(sized.count(), most=1 << 16)
    placed = sized.withColumn("chunk", F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * chunks / 65536))
    placed = running_totals(placed, ["key"], "chunk", ["h", "id", "size", "row_hash"], F.col("size"), "start")
    placed = saved(placed.drop("source").join(small(sources), "key").select("id", "source", "key", "size", "start", "source_size", "target", "take", "row_hash"))
    passes = placed.where("size > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    passes = passes.withColumn("at", F.col("start") + F.col("pass_no") * F.col("source_size")).withColumn("end", F.least(F.col("at") + F.col("size"), F.col("take"))).where("at < end")
    pieces = passes.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    begin, over = F.greatest("at", F.col("block") * block) - F.col("at"), F.least("end", (F.col("block") + 1) * block) - F.col("at")
    pieces = pieces.select("key", "block", "source", "id", "row_hash", "start", "size", "pass_no", begin.alias("from_word"), over.alias("to_word"))
    spans = saved(schedule(sources, block).join(pieces, ["key", "block"]))
    taken = spans.groupBy("key", "start", "size").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.count("*").alias("slots"), F.min("slot").alias("first_slot"))
    rows = placed.join(taken, ["key", "start", "size"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("taken", "slots")})
    return rows.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken", "slots", "first_slot", "row_hash", "start"), spans.select("slot", "source", F.col("id").alias("doc_id"), "row_hash", "start", "pass_no", "from_word", "to_word")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; what holds a map is hashed as JSON, since Spark hashes no maps."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The mix as documents: each reading of a document is a row with all of its columns, its text cut where the source's target ends.

    A document that is read twice comes twice; one that isn't read goes.
    """
    _, spans = mix(docs, text=text, doc_id=doc_id, **how)
    reads = spans.groupBy("doc_id", "row_hash", "source", "start", "pass_no").agg(F.max("to_word").alias("words"), F.min_by("slot", "from_word").alias("slot"))
    reads = reads.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), F.struct("slot", "source", "start", "pass_no", "words").alias("_read"))
    rows = docs.select(packed(docs).alias("_row"), F.col(f"`{doc_id}`").alias("_id"), row_hash(docs).alias("_hash"), word_count(F.col(f"`{text}`")).alias("_size"))
    found = reads.join(rows.dropDuplicates(["_id", "_hash"]), ["_hash"]).where(reads["_id"].eqNullSafe(rows["_id"]))
    whole = F.col("_row").getField(text)
    words = F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    short = F.array_join(F.slice(words, F.lit(1), F.col("_read.words").cast("int")), "")
    kept = F.when(F.col("_read.words") >= F.col("_size"), whole).otherwise(short)
    found = found.sortWithinPartitions("_read")
    return found.select(*[(kept if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns])
