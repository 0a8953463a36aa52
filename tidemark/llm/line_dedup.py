"""Lines that several documents hold: all but the first document's are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BLANKS, packed, saved


def line_key_hashes(line: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a stripped line with A-Z lower-cased.

    Read as Latin-1, each byte of UTF-8 is a character. Lower-casing then maps A-Z as wanted and, beyond ASCII,
    only lead bytes of two-byte characters, to values that no other two-byte character has: keys stay distinct.
    """
    low = F.lower(F.decode(line.cast("binary"), "ISO-8859-1"))
    return F.xxhash64(low), F.xxhash64(F.lit("second"), low)


def drop_common_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its text rid of common lines, and n_lines (before) and n_dropped (both long).

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least min_chars code points that
    at least min_docs documents hold go everywhere but in the smallest doc_id that holds them, there all of their lines stay.

    Null or empty text is one empty line; a null text comes back empty. Rows of one doc_id are one document. A row without
    doc_id is no document: it keeps its lines and makes none common. An empty table gives an empty table. Other columns
    are kept; n_lines and n_dropped replace columns of these names.

    Lines are exploded, hashed (128 bits) and aggregated by hash; positions to drop are gathered per row, and each text is
    rebuilt by position from the runs of lines between them, in time linear in its lines.
    """
    lines = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)
    rows = docs.select(packed(docs).alias("row"), F.col(f"`{doc_id}`").alias("id"), lines.alias("lines"), F.xxhash64(F.col(f"`{text}`")).alias("t"))
    each = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.posexplode(lines).alias("pos", "line"))
    each = each.where(F.col("id").isNotNull()).withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.length("line") >= min_chars)
    h1, h2 = line_key_hashes(F.col("line"))
    each = each.select("id", "t", "pos", h1.alias("h1"), h2.alias("h2"))
    found = each.groupBy("h1", "h2")
    if min_docs == 2:  # two documents or more: their smallest and largest ids differ
        common = found.agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    else:
        common = found.agg(F.min("id").alias("first"), F.count_distinct("id").alias("n")).where(F.col("n") >= min_docs)
    common = saved(common.select("h1", "h2", "first"))
    gone = each.join(common, ["h1", "h2"]).where("id <> first").groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    rows = rows.join(gone, ["id", "t"], "left")
    rows = rows.withColumn("cuts", F.concat(F.array(F.lit(-1)), F.coalesce("gone", F.array().cast("array<int>")), F.array(F.size("lines"))))
    cut = lambda i: F.element_at("cuts", i)
    runs = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.slice("lines", cut(i) + 2, cut(i + 1) - cut(i) - 1))
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.flatten(runs), "\n"))
    out = rows.select(*[(kept if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")], F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return out
