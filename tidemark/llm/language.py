"""Language of documents and pages: Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tidemark.llm.mixing import row_hash
from tidemark.llm.shared import cut_without_loss, in_pieces, packed, saved, small, whole_texts

#: Rows of each language that the text model is fitted on, in expectation; hashed byte trigrams; trigrams whose evidence counts in full; posterior below which a document is rejected.
SAMPLE, SIZE, EVIDENCE, THRESHOLD = 4000, 1 << 16, 200, 0.5
#: Pseudo-counts: of a trigram, of a level of host priors, of a declared language or suffix that says what the text says.
SMOOTH, LEVEL, TRUST = 0.2, 20.0, 10.0
WINDOW = 1 << 20
#: Values that sampling hashes take; texts with a trigram, which need one byte of a letter.
HASHES, LETTER = 1 << 40, r"[A-Za-z]|[^\x00-\x7F]"

LETTERS = np.full(256, 32, np.uint8)
LETTERS[65:91] = LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashed byte trigrams around letters of a lower-cased whole text, in windows of bounded size."""
    raw = LETTERS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    for i in range(0, len(raw) - 2, WINDOW):
        b = raw[i : i + WINDOW + 2].astype(np.uint32)
        held = b[1:-1] != 32
        code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435769) >> np.uint32(16)
        yield code[held]


def fit(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by language and trigram) of rows (text, label). The driver gets at most SIZE numbers a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for codes in trigrams(text):
                    counts.setdefault(label, np.zeros(SIZE, np.int64))
                    counts[label] += np.bincount(codes, minlength=SIZE)
        for label, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"label": [label] * len(at), "code": at, "n": n[at]})

    rows = sample.mapInArrow(run, "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["label"].unique())
    table = np.full((len(names), SIZE), SMOOTH)
    for i, name in enumerate(names):
        own = rows[rows["label"] == name]
        table[i, own["code"].to_numpy()] += own["n"].to_numpy()
    return names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def subtag(c: Column) -> Column:
    """The primary language of a declared one: "en" of "en-GB"; null if it doesn't begin with letters."""
    return F.nullif(F.regexp_extract(F.lower(c), r"^\s*([a-z]{2,3})(?![a-z])", 1), F.lit(""))


def identify(docs: DataFrame, text: str = "text", declared: str | None = "lang", url: str | None = None, host: str | None = "source", doc_id: str = "doc_id", label: str | None = "lang", wanted: list[str] | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row_hash, lang, posterior, declared, accepted) for each row.

    The text model (hashed byte trigrams, whole texts) knows every language that labels a row with letters. It is fitted on the rows whose hash of doc_id
    falls below their label's bound, which lets `sample` rows of each label through in expectation (all of a label with fewer, and never none). All else is counted over all rows: how often each declared language, and each suffix of
    the url's host, goes with a language by text; and priors of hosts, smoothed towards their site's (the host's last two names), and these
    towards that of all rows. The posterior is the product of the four, where a null declared language, url or host adds nothing. Text counts as at most
    EVIDENCE independent trigrams, so the rest matters for short texts.

    lang is null, and the row rejected, if the text (null or not) has no letters. A row also is rejected if its posterior is below threshold, or its language isn't among `wanted`
    (null: all that the model knows). Repeated rows get equal results, null ids are rows like any other. Without any label all rows are rejected;
    an empty table gives an empty one. Ties go to the language that is first by name.
    """
    name = lambda c: F.lit(None).cast("string") if c is None else F.col(f"`{c}`").cast("string")
    address = F.lower(F.regexp_extract(name(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    site = F.nullif(address, F.lit("")) if host is None else name(host)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), row_hash(docs).alias("row_hash"), F.coalesce(name(text), F.lit("")).alias("text"), subtag(name(declared)).alias("declared"), F.nullif(F.regexp_extract(address, r"\.([a-z]{2,})$", 1), F.lit("")).alias("suffix"), site.alias("host"), subtag(name(label)).alias("label"))
    labelled = rows.where("label is not null").where(F.col("text").rlike(LETTER)).withColumn("hash", F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(HASHES)))
    bounds = labelled.groupBy("label").agg(F.greatest(F.min("hash") + 1, F.ceil(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")) * HASHES)).alias("below"))
    names, table = fit(labelled.join(small(saved(bounds)), "label").where("hash < below").select("text", "label"))
    if not names:
        return rows.select("doc_id", "row_hash", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), "declared", F.lit(False).alias("accepted"))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_texts(batches):
            out = []
            for t in batch.columns[-1]:
                total, n = np.zeros(len(names)), 0
                for codes in trigrams(t.as_py()):
                    total += table[:, codes].sum(1, dtype=np.float64)
                    n += len(codes)
                out.append(total * (min(n, EVIDENCE) / n) if n else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "text_log"])

    rows = rows.drop("label")
    scored = StructType([f for f in rows.schema if f.name != "text"]).add("text_log", ArrayType(DoubleType()))
    rows = saved(in_pieces(rows).mapInArrow(likelihood, scored))
    top = F.array_position("text_log", F.array_max("text_log")).cast("int") - 1
    by_text = rows.where("text_log is not null").withColumn("l", top)
    langs = F.sequence(F.lit(0), F.lit(len(names) - 1))

    def tally(key: str) -> DataFrame:
        """Per value of key, rows by language (array) and in all."""
        each = by_text.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.count_if(F.col("l") == i).alias(f"n{i}") for i in range(len(names))])
        return each.select(key, F.array(*[F.col(f"n{i}").cast("double") for i in range(len(names))]).alias("n"))

    whole = by_text.agg(*[F.count_if(F.col("l") == i) for i in range(len(names))]).first()
    overall = [(n + 1.0) / (sum(whole) + len(names)) for n in whole]
    prior = F.array(*map(F.lit, overall))
    # P(declared | language), P(suffix | language): pseudo-counts trust a declared language; a suffix's follow the language that it mostly goes with
    says = tally("declared").select("declared", F.transform(langs, lambda i: F.log((F.get("n", i) + F.when(F.col("declared") == F.get(F.array(*map(F.lit, names)), i), TRUST).otherwise(0.1)) / (F.get(F.array(*map(F.lit, map(float, whole))), i) + TRUST + 0.1 * len(names)))).alias("declared_log"))
    ends = tally("suffix").select("suffix", F.transform(langs, lambda i: F.log((F.get("n", i) + TRUST * F.get(prior, i)) / (F.get(F.array(*map(F.lit, map(float, whole))), i) + TRUST))).alias("suffix_log"))
    total = lambda n: F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
    hosts = saved(tally("host").withColumn("site", F.regexp_extract("host", r"([^.]+\.[^.]+|[^.]+)$", 1)))
    sites = saved(hosts.groupBy("site").agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(len(names))]).select("site", F.array(*[F.col(f"n{i}") for i in range(len(names))]).alias("m")))
    at_site = F.transform(langs, lambda i: (F.get("m", i) + LEVEL * F.get(prior, i)) / (total(F.col("m")) + LEVEL))
    hosts = hosts.join(small(sites), "site").withColumn("s", at_site)
    hosts = saved(hosts.select("host", F.transform(langs, lambda i: F.log((F.get("n", i) + LEVEL * F.get("s", i)) / (total(F.col("n")) + LEVEL))).alias("host_log")))
    none = F.array(*[F.lit(0.0)] * len(names))
    logs = rows.join(small(saved(says)), "declared", "left").join(small(saved(ends)), "suffix", "left").join(small(hosts), "host", "left")
    prior_log = F.coalesce("host_log", F.transform(prior, lambda p: F.log(p)))
    fused = F.transform(langs, lambda i: F.get("text_log", i) + F.get(F.coalesce("declared_log", none), i) + F.get(F.coalesce("suffix_log", none), i) + F.get(prior_log, i))
    logs = logs.withColumn("fused", F.when(F.col("text_log").isNotNull(), fused)).withColumn("most", F.array_max("fused"))
    lang = F.get(F.array(*map(F.lit, names)), F.array_position("fused", F.col("most")).cast("int") - 1)
    posterior = F.coalesce(1.0 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most"))), F.lit(0.0))
    logs = logs.select("doc_id", "row_hash", lang.alias("lang"), posterior.alias("posterior"), "declared")
    fine = F.col("lang").isNotNull() & (F.col("posterior") >= threshold) & (F.col("lang").isin(wanted) if wanted is not None else F.lit(True))
    return logs.withColumn("accepted", fine)


def identify_pages(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", **how) -> DataFrame:
    """As identify(), for pages: markup is cut from the text and character references are decoded, the declared language is the html element's, suffix and host are the url's."""

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(unescape, na_action="ignore")

    plain = F.regexp_replace(F.regexp_replace(F.col(f"`{html}`"), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    said = F.regexp_extract(F.col(f"`{html}`"), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1)
    rows = pages.select(F.col(f"`{page_id}`").alias("doc_id"), F.col(f"`{url}`").alias("url"), decoded(plain).alias("text"), said.alias("lang"))
    return identify(rows, url="url", host=None, **how).withColumnRenamed("doc_id", "page_id")


def only_accepted(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """docs without the rows that identify() rejects; text is shuffled only if the rejected are many."""
    found = saved(identify(docs, doc_id=doc_id, **how).where(~F.col("accepted")).select("doc_id", "row_hash"))
    rows = docs.select(packed(docs).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), row_hash(docs).alias("row_hash"))
    return cut_without_loss(rows, found, ["doc_id", "row_hash"]).select("row.*")
