"""Audit of sources: how far each source's terms lie from those of its language and of the other sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import saved

#: Sources in a tile and kept terms in a bucket, on average: a task compares the sources of two tiles over the terms of a bucket.
TILE, BUCKET = 64, 1024
#: Entries that a task counts before it hands them on, and terms among which dominance is looked for at once.
HELD, CHUNK = 400_000, 2048


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of documents (lang, source, text), counted in each task by itself: several rows for a term, to be added up.

    Terms are runs of ASCII letters and of what is not ASCII, A-Z lower-cased; in UTF-8 both are told by the byte. A task holds HELD entries and one document's.
    """
    table = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}
        held = 0

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in seen.items():
                terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(n)), pa.repeat(pa.scalar(source, pa.string()), len(n)), terms, pa.array(n.values(), pa.int64()), pa.array((d[t] for t in n), pa.int64())], schema=schema)

        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                if (lang, source) not in seen:
                    seen[lang, source] = [Counter(), Counter()]
                n, d = seen[lang, source]
                held -= len(n)
                here = Counter(text.translate(table).split())
                n.update(here)
                d.update(here.keys())
                held += len(n)
                if held > HELD:
                    yield from given()
                    seen, held = {}, 0
        yield from given()

    return docs.mapInArrow(counted, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, kept: Column, smooth: int, scale: int) -> Column:
    """1 + floor(scale * (n + smooth) / (total + smooth * kept)), in whole numbers of any size."""
    exact = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", exact(n + smooth) * F.lit(scale).cast("decimal(10,0)"), exact(total + kept * smooth)) + 1


def skyband(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The rows (n, total, term) that fewer than k others dominate: with no lower n, no higher total and no later term, and not the same in all three.

    Rows are taken by falling n, so that dominators stand earlier; only those of the band need be counted, since the first k dominators of any row are dominated by fewer than k.
    """
    if len(rows) <= k:
        return rows
    rows = rows.assign(bytes=rows["term"].str.encode("utf-8"))
    rows = rows.sort_values(["n", "total", "bytes"], ascending=[False, True, True], ignore_index=True)
    order = rows["bytes"].rank(method="dense").to_numpy()
    total = rows["total"].to_numpy()
    kept = np.zeros(len(rows), bool)
    kept[:k] = True
    held = np.arange(min(k, len(rows)))
    for start in range(k, len(rows), 256):
        at = np.arange(start, min(start + 256, len(rows)))
        over = ((total[held][None, :] <= total[at][:, None]) & (order[held][None, :] <= order[at][:, None])).sum(axis=1)
        for i, m in zip(at, over):
            if m < k:
                new = held[held >= start]
                if m + ((total[new] <= total[i]) & (order[new] <= order[i])).sum() < k:
                    kept[i] = True
                    held = np.append(held, i)
    return rows[kept].drop(columns="bytes")


def retained(rows: DataFrame, k: int) -> DataFrame:
    """Of each group's rows in a partition the skyband; rows are (lang, source, term, n, total, f)."""

    def bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple, pd.DataFrame] = {}
        waits: dict[tuple, list] = {}
        size: Counter = Counter()
        held = 0

        def closed(key: tuple) -> None:
            nonlocal held
            before = len(kept[key]) if key in kept else 0
            kept[key] = skyband(pd.concat([*([kept[key]] if before else []), *waits.pop(key)]), k)
            held += len(kept[key]) - before - size.pop(key)

        for frame in frames:
            for key, part in frame.groupby(["lang", "source"], sort=False):
                waits.setdefault(key, []).append(part)
                size[key] += len(part)
                held += len(part)
                if size[key] >= CHUNK:
                    closed(key)
            if held > HELD:  # many groups: hand on what is there and begin again
                for key in list(waits):
                    closed(key)
                yield from kept.values()
                kept, held = {}, 0
        for key in list(waits):
            closed(key)
        yield from kept.values()

    return rows.mapInPandas(bands, rows.schema)


def differences(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - p'| of the sources of two tiles over a bucket's terms; rows without term give a source's p where it lacks one."""
    lang, _, lo, hi = key
    names, base = rows.loc[rows["term"].isna(), ["tile", "source", "p"]].sort_values(["tile", "source"]), rows[rows["term"].notna()]
    at = pd.Series(np.arange(len(names)), index=names["source"].to_numpy())
    codes, found = pd.factorize(base["term"])
    p = np.repeat(names["p"].to_numpy(np.int64)[:, None], max(1, len(found)), axis=1)
    p[at[base["source"]].to_numpy(), codes] = base["p"].to_numpy(np.int64)
    if not len(found):
        p[:] = 0
    low = int((names["tile"] == lo).sum())
    out = []
    for i in range(low):
        others = np.arange(i + 1, low) if lo == hi else np.arange(low, len(names))
        out.append((np.full(len(others), i), others, np.abs(p[others] - p[i]).sum(axis=1)))
    a, b, value = (np.concatenate(x) if out else np.array([], np.int64) for x in (zip(*out) if out else ((), (), ())))
    name = names["source"].to_numpy()
    return pd.DataFrame({"lang": lang, "a": name[a], "b": name[b], "value": value})


def audit_sources(docs: DataFrame, min_docs: int = 30, top: int = 50, smooth: int = 5, scale: int = 1_000_000_000, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part pair tells how far a source lies from every other of its language, part term which terms set it apart from its language.

    Each language keeps the terms of at least min_docs of its documents. A source gives each of them p = 1 + floor(scale * (n + smooth) / (N + smooth * V)), n being its
    occurrences there, N the sum of n, V the number of kept terms; a language likewise. pair: value is the sum of |p - p'| over the language's kept terms (0, if it keeps none).
    term: the top terms by p of the source less p of the language, of those that occur in the source and have a positive difference. Ranks run from 1 in each group and part,
    ties to the item whose UTF-8 is less.

    Null text, language or source is an empty string, which is a text without terms, a language and a source like any other. Each row is a document: repeated rows count anew. Very long
    texts are read whole. An empty table gives no rows; other columns, whatever their names, are not read.

    Occurrences are counted in the tasks that read the texts, then added up by one shuffle on (language, term), so a hot source is spread over its terms. Of a source's
    terms each partition retains those that fewer than `top` others dominate (higher count, lower count in the language, earlier UTF-8): only these can be among the top. Skybands are merged,
    then ranked exactly. Pairs are compared in cells of two tiles of sources and a bucket of terms, whose sums are added up; no task gets all of a language's sources or terms.
    """
    part = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    spread = count_terms(part).repartition("lang", "term")  # both aggregations below keep this partitioning
    counts = spread.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("total", F.sum("n").over(by_term)).withColumn("docs", F.sum("docs").over(by_term)).where(F.col("docs") >= min_docs)
    counts = saved(counts.select("lang", "source", "term", "n", "total"))

    found = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_distinct("term").alias("kept"))
    groups = part.select("lang", "source").distinct().join(found, ["lang", "source"], "left")
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left").na.fill(0, ["lang_size", "kept"])
    groups = groups.na.fill(0, ["size"]).join(per_lang, "lang").withColumn("tiles", F.expr(f"1 + sources div {TILE}")).withColumn("tile", F.expr("pmod(xxhash64(source), tiles)"))
    groups = saved(groups.withColumn("buckets", F.expr(f"1 + kept div {BUCKET}")))

    p = lambda n: share(n, F.col("size"), F.col("kept"), smooth, scale)
    rows = counts.join(groups, ["lang", "source"])
    q = share(F.col("total"), F.col("lang_size"), F.col("kept"), smooth, scale)
    apart = rows.select("lang", "source", "term", "n", "total", (p(F.col("n")) - q).alias("f")).where("f > 0")
    merged = retained(retained(apart, top).repartition("lang", "source"), top)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("f"), "term"))
    terms = merged.withColumn("rank", place).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("f").alias("value"), "rank")

    bases = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"), "tile", "tiles", "source", F.lit(None).cast("string").alias("term"), F.when(F.col("kept") > 0, p(F.lit(0).cast("long"))).otherwise(0).alias("p"))
    values = rows.select("lang", F.expr("pmod(xxhash64(term), buckets)").alias("bucket"), "tile", "tiles", "source", "term", p(F.col("n")).alias("p"))
    cells = bases.unionByName(values).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    cells = cells.select("lang", "bucket", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "source", "term", "p")
    sums = cells.groupBy("lang", "bucket", "lo", "hi").applyInPandas(differences, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e"), "value")
    pairs = ends.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.unionByName(terms)
