"""The corpus operators over whole tables, with SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.quality import STOP_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable) -> Callable:
    """Registers a query under its own name."""
    QUERIES[f.__name__] = f
    return f


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of 2048."""
    import public_tokenizers

    from tidemark.llm.packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document gives to the mix, and in which slots of its schedule."""
    from tidemark.llm.mixing import mix

    rows, _ = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "slots", "first_slot")


ORACLE["op2_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sized GROUP BY source),
sums AS (
  SELECT *, row_number() OVER o AS nth,
    1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
    (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS over_w
  FROM per WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST)),
level AS (SELECT min_by(struct_pack(nth := nth, rest := rest, over_w := over_w), nth) AS l FROM sums WHERE NOT rest * w / over_w > 2 * source_size),
targets AS (
  SELECT source, source_size, CASE WHEN l IS NULL OR nth < l.nth THEN (2 * source_size)::DOUBLE ELSE l.rest * w / l.over_w END AS target FROM sums, level),
placed AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS take,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
parts AS (
  SELECT *, sum(blocks) OVER (ORDER BY key)::BIGINT AS hi, sum(blocks) OVER ()::BIGINT AS total
  FROM (SELECT coalesce('=' || source, '~') AS key, ceil(floor(target + 0.5) / 1024)::BIGINT AS blocks FROM targets) WHERE blocks > 0),
points AS (SELECT i AS slot, i * 1327217885 % 2147483648 AS p FROM (SELECT unnest(range(0, (SELECT max(total) FROM parts))) AS i)),
drawn AS (
  SELECT slot, key, blocks, total, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS block FROM points JOIN parts
  ON p >= floor((hi - blocks)::DOUBLE / total::DOUBLE * 2147483648) AND p < floor(hi::DOUBLE / total::DOUBLE * 2147483648)),
slots AS (
  SELECT slot, key, block FROM drawn WHERE block < blocks UNION ALL
  SELECT total + block, key, block FROM (SELECT *, unnest(range((SELECT count(*) FROM drawn d WHERE d.key = parts.key), blocks)) AS block FROM parts)),
passes AS (SELECT doc_id, source, start + n * source_size AS begun, least(start + n * source_size + size, take) AS till FROM placed, range(2) r(n) WHERE size > 0 AND start + n * source_size < take),
pieces AS (SELECT *, unnest(range(begun // 1024, (till - 1) // 1024 + 1)) AS block FROM passes),
stood AS (SELECT doc_id, count(*) AS slots, min(slot) AS first_slot FROM pieces p JOIN slots s ON s.key = coalesce('=' || p.source, '~') AND s.block = p.block GROUP BY doc_id)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, take) - start) + greatest(0, least(source_size + start + size, take) - source_size - start))::BIGINT AS taken, coalesce(slots, 0) AS slots, first_slot FROM placed LEFT JOIN stood USING (doc_id)"""


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of eight, its slot there and its shard of nine."""
    from tidemark.llm.sharding import assign_shards

    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign_shards(rows.withColumn("law", F.lit("key")), [1.0] * 8, "doc_id", [1.0] * 9, F.struct("size", "text_crc32"))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, how many of them go, and a digest of the rest."""
    from tidemark.llm.line_dedup import drop_common_lines

    kept = drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE["op8_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.*, coalesce(l.doc_id <> c.first_doc, false) AS gone FROM keyed l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth, by inner product."""
    from tidemark.llm.topk import exact_top_k, quantized

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantized(F.col("embedding")).alias("vector"))
    found = exact_top_k(vectors, vectors.where("id % 50 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE["op6_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query
def op7_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    from tidemark.llm.archives import archived

    rows = archived(table(spark, sf_dir, "pages"))
    return rows.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op7_archives"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS kept, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, p.payload_bytes, p.payload_digest, CASE WHEN n > 1 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id <> kept THEN kept END AS refers_to
FROM p LEFT JOIN k USING (payload_digest, payload_bytes)"""


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and how like it are its edited text's and the next document's."""
    from tidemark.llm.edit_embedding import fingerprint

    return fingerprint(table(spark, sf_dir, "documents"))


@query
def op10_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth document, the documents whose fingerprints are at least 0.8 like its own."""
    from tidemark.llm.edit_embedding import only_prints, similar_pairs
    from tidemark.llm.shared import saved

    prints = saved(only_prints(table(spark, sf_dir, "documents")))
    found = similar_pairs(prints, prints.where("doc_id % 20 = 0"))
    return found.select("query_id", "doc_id", F.round("near", 6).alias("near"))


@query
def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    from tidemark.llm.extraction import extract_pages

    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


ORACLE["op4_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda x:
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))),
  lambda x: x <> '') AS parts FROM a)
SELECT page_id, url, array_to_string(parts, chr(10) || chr(10)) AS text, length(array_to_string(parts, chr(10) || chr(10))) AS n_chars FROM b"""


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; sources stand for hosts."""
    from tidemark.llm.language import identify

    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "lang", F.round("posterior", 6).alias("posterior"), "declared", "accepted")


@query
def op9_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's language, with what its markup, suffix and host say."""
    from tidemark.llm.language import identify_pages

    found = identify_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "lang", F.round("posterior", 6).alias("posterior"), "declared", "accepted")


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates."""
    from tidemark.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and the verdict of the rules."""
    from tidemark.llm.quality import judge_quality

    found = judge_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE["op13_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS t,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS pos FROM twice) GROUP BY r),
stop AS (SELECT list(x) || list(upper(x[1]) || x[2:]) AS listed FROM (SELECT unnest(string_split('STOP', ' ')) AS x)),
counts AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l) AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: list_contains(listed, x))) AS n_stop_words,
    len(list_filter(w, lambda x, i: i > 1 AND w[i - 1] = x)) AS n_echoed_words, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣●]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines
  FROM d LEFT JOIN covered USING (r), stop),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1200 * n_words AND 100 * n_symbols <= 10 * n_words AND (100 * n_stop_words >= 2 * n_words OR coalesce(lang NOT IN ('en', 'de', 'fr', 'es'), false))
  AND 100 * n_echoed_words <= 30 * n_words AND 100 * n_dup_lines <= 60 * n_lines AND 100 * n_bullet_lines <= 90 * n_lines AND 100 * n_cut_lines <= 40 * n_lines AS kept
FROM judged""".replace("STOP", " ".join(w for ws in STOP_WORDS.values() for w in ws))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source lies from the others of its language, and the terms that set it apart."""
    from tidemark.llm.divergence import audit_sources

    return audit_sources(table(spark, sf_dir, "documents"))


ORACLE["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (s.total + 5 * v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * v))::BIGINT AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
found AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM found QUALIFY part = 'pair' OR rank <= 50"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults, its cheapest repair and a digest of it."""
    from tidemark.llm.conversations import repair_conversations

    return repair_conversations(table(spark, sf_dir, "conversations"))
