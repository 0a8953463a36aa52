"""Company identifiers: readers, name map, resolution, autocompletion."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import islice
from typing import IO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import kept

#: Rows up to which a table of queries is broadcast.
FEW = 100_000


def counted(df: DataFrame) -> tuple[DataFrame, str]:
    """A table of queries, computed once, and how it is to be joined: by broadcast if a count finds few rows, else by a merge. Spark itself takes what is exploded from a small file for small, and would send that to the driver."""
    df = kept(df)
    return df, "broadcast" if df.limit(FEW + 1).count() <= FEW else "merge"


def normalize_ticker(c: Column) -> Column:
    """A ticker without white space, in upper case."""
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def ticker_variants(c: Column) -> Column:
    """Ways to write a ticker, in order of preference."""
    base = normalize_ticker(c)
    ways = [base, F.replace(base, F.lit("."), F.lit("-")), F.replace(base, F.lit("-"), F.lit(".")), F.regexp_replace(base, "[.-]", ""), F.regexp_replace(base, r"^(.*)\.[^.]*$", "$1")]
    return F.filter(F.array_distinct(F.array(*ways)), lambda x: x != "")


def normalize_name(c: Column) -> Column:
    """A company's name for comparison: without legal forms (English ones only as last words), punctuation and case."""
    bare = F.trim(F.regexp_replace(c, r"주식회사|\(주\)|㈜", ""))
    bare = F.regexp_replace(bare, r"(?i)(?:[,\s]+(?:inc|corp|corporation|co|company|ltd|limited|plc|holdings?|group)\.?)+$", "")
    return F.upper(F.regexp_replace(bare, r"[\s.,\-_/&'\"]+", ""))


def format_yyyymmdd(c: Column) -> Column:
    """A day of eight digits with dashes; other values as they are."""
    return F.regexp_replace(F.trim(c), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def company_tickers(raw: DataFrame, least: int = 1000) -> DataFrame:
    """Companies (key, ticker, name, aliases) of ticker files (json: a map of rows): a key's first row represents it, its further tickers are aliases. Fewer rows than `least` are an error."""
    rows = raw.select(F.explode(F.from_json("json", "map<string,struct<cik_str:long,ticker:string,title:string>>")).alias("k", "r"))
    rows = rows.select(F.col("k").try_cast("int").alias("pos"), F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("key"), normalize_ticker(F.col("r.ticker")).alias("ticker"), F.col("r.title").alias("name"))
    one = rows.groupBy("key").agg(F.min_by("name", "pos").alias("name"), F.sort_array(F.collect_list(F.struct("pos", "ticker"))).alias("t"))
    one = one.crossJoin(F.broadcast(rows.agg(F.count("*").alias("rows"))))  # one row
    fine = F.when(F.col("rows") < least, F.raise_error(F.lit("too few companies"))).otherwise(F.col("key"))
    return one.select(fine.alias("key"), F.col("t")[0]["ticker"].alias("ticker"), "name", F.transform(F.slice(F.col("t"), F.lit(2), F.size("t")), lambda x: x["ticker"]).alias("aliases"))


#: Bytes inflated at a time, and records in a batch.
CHUNK, BATCH = 1 << 20, 4096


def zipped_records(files: DataFrame, end: str, encoding: str = "utf-8", member: str = "") -> DataFrame:
    """(path, record) of zipped text files (path, content), of members with a name's ending: what stands before each `end` and after the last.

    Members are inflated piece by piece and handed on in batches, so no cell holds a whole one. For lists that are large, let write_records lay them down once: those files are read in splits.
    """
    mark = end.encode(encoding)

    def cut(stream: IO[bytes]) -> Iterator[bytes]:
        rest = bytearray()
        while piece := stream.read(CHUNK):
            seen = max(0, len(rest) - len(mark))
            rest += piece
            if rest.find(mark, seen) >= 0:
                *whole, last = bytes(rest).split(mark)
                yield from whole
                rest = bytearray(last)
        yield bytes(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.lower().endswith(member):
                            with z.open(name) as stream:
                                records = (r.decode(encoding, "replace") for r in cut(stream))
                                while some := list(islice(records, BATCH)):
                                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some), pa.string()), pa.array(some, pa.string())], ["path", "record"])

    return files.select("path", "content").mapInArrow(run, "path string, record string")


def write_records(records: DataFrame, path: str, end: str) -> None:
    """Lays records down as text files that end each with `end`, for read_records."""
    records.select("record").write.mode("overwrite").option("lineSep", end).text(path)


def read_records(spark: SparkSession, path: str, end: str, encoding: str = "utf-8") -> DataFrame:
    """(path, record) of plain text files, however large: a file is read in splits by as many tasks, each beginning after an `end`. The end must be of ASCII; encodings that Java lacks are decoded in Python."""
    rows = spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("record"))
    if encoding == "utf-8":
        return rows

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v.decode(encoding, "replace"))

    return rows.withColumn("record", decoded(F.col("record").cast("binary")))


def corp_codes(records: DataFrame, least: int = 100) -> DataFrame:
    """Listed companies (key, ticker, name, name_en, as_of) of the records (see zipped_records, read_records) of XML lists that end with </list>; as_of is the latest change of any. Fewer than `least` are an error."""
    each = records.select(F.regexp_extract("record", r"(?s)<list>(.*)$", 1).alias("b")).where("b <> ''")
    part = lambda n: F.trim(F.regexp_extract("b", rf"(?s)<{n}>(.*?)</{n}>", 1))
    rows = each.select(part("corp_code").alias("key"), part("stock_code").alias("ticker"), part("corp_name").alias("name"), part("corp_eng_name").alias("name_en"), part("modify_date").alias("m")).where("ticker <> ''")
    whole = rows.agg(F.count("*").alias("n"), format_yyyymmdd(F.max("m")).alias("as_of"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    return rows.select(F.when(F.col("n") < least, F.raise_error(F.lit("too few companies"))).otherwise(F.col("key")).alias("key"), "ticker", "name", "name_en", "as_of")


# Of a market's rows the width of the block at the right end, and where in it (from 0) group, halt, kind of share and market value stand.
MASTERS = {
    "KOSPI": {"tail": 227, "group": (0, 2), "halted": (60, 61), "preferred": (158, 159), "market_cap": (212, 221)},
    "KOSDAQ": {"tail": 221, "group": (0, 2), "halted": (55, 56), "preferred": (153, 154), "market_cap": (206, 215)},
}
SPAC, MASTER_ENCODING = "스팩|기업인수목적", "cp949"


def stock_master(records: DataFrame, exchange: str) -> DataFrame:
    """Stocks that trade (key, ticker, name, source, exchange, rank_hint, market_cap) of a market's fixed-width rows (record; see zipped_records, read_records), whose layout counts from the right end.

    Only shares (group ST) that aren't halted; rank_hint puts common before preferred shares and these before shells for mergers; market_cap is 0 where it isn't a number.
    """
    at = MASTERS[exchange]
    lines = records.select(F.regexp_replace("record", r"\r$", "").alias("line")).where(F.length("line") > at["tail"] + 21)
    rows = lines.select("line", F.substring("line", F.length("line") - at["tail"] + 1, F.lit(at["tail"])).alias("tail"))
    part = lambda name: F.trim(F.substring("tail", at[name][0] + 1, at[name][1] - at[name][0]))
    rows = rows.select(normalize_ticker(F.substring("line", 1, 9)).alias("key"), F.trim(F.substring("line", F.lit(22), F.length("line") - at["tail"] - 21)).alias("name"), *[part(n).alias(n) for n in ("group", "halted", "preferred", "market_cap")])
    rows = rows.where("group = 'ST' and halted <> 'Y' and key <> '' and name <> ''")
    hint = F.when(F.col("name").rlike(SPAC), 2).when(F.col("preferred").isin("", "0"), 0).otherwise(1)
    cap = F.when(F.col("market_cap").rlike("^[0-9]+$"), F.col("market_cap").cast("double")).otherwise(0.0)
    return rows.select("key", F.col("key").alias("ticker"), "name", F.lit(f"KIS 종목마스터({exchange})").alias("source"), F.lit(exchange).alias("exchange"), hint.alias("rank_hint"), cap.alias("market_cap"))


def stock_masters(masters: list[DataFrame], least: int = 500) -> DataFrame:
    """The markets' stocks in one table; fewer than `least` in all are an error."""
    rows = masters[0]
    for more in masters[1:]:
        rows = rows.unionByName(more)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n"))))  # one row
    return rows.withColumn("key", F.when(F.col("_n") < least, F.raise_error(F.lit("too few stocks"))).otherwise(F.col("key"))).drop("_n")


def holders(needles: DataFrame, names: DataFrame) -> DataFrame:
    """(needle, name): the names that hold a needle, by equi-joins: a needle goes by the one of its grams that the fewest names hold, then what shares that is verified.

    Grams have three characters, or as many as the needle if that is shorter.
    """
    needles, how = counted(needles.select("needle").where("needle <> ''").distinct().withColumn("size", F.least(F.lit(3), F.length("needle"))))
    names = names.select("name").where("name <> ''").distinct()
    grams = lambda c, size: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - size + 1)), lambda i: F.substring(F.col(c), i, size)))
    sizes = names.crossJoin(F.broadcast(names.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("size"))))  # three rows
    index = sizes.select("name", "size", F.explode(grams("name", F.col("size"))).alias("gram")).where(F.length("gram") == F.col("size"))
    asked = needles.select("needle", F.explode(grams("needle", F.col("size"))).alias("gram"))
    counts = index.join(asked.select("gram").distinct().hint(how), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rare = asked.join(counts.hint("merge"), "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    return rare.hint(how).join(index, "gram").where(F.contains("name", F.col("needle"))).select("needle", "name")


def name_map(companies: DataFrame) -> DataFrame:
    """(name_key, keys): normalised names and the companies that bear them; several keys make a name ambiguous."""
    names = companies.select("key", F.explode(F.array(*[normalize_name(F.col(c)) for c in ("name", "name_en") if c in companies.columns])).alias("name_key")).where("name_key <> ''")
    return names.groupBy("name_key").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def resolve_companies(queries: DataFrame, companies: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(query, key, method, error) of queries: by key, by ticker (its variants in order), by unique name, by alias, by unique part of a name; an ambiguous name is refused.

    Only queries that all equi-joins leave open are compared with parts of names.
    """
    q = queries.select("query").distinct().withColumn("c", F.trim("query"))
    q = q.withColumns({"k": F.when(F.col("c").rlike(r"^\d{8,10}$"), F.col("c")), "nk": normalize_name(F.col("c"))})
    by_key = q.join(companies.select(F.col("key").alias("k")), "k").select("query", F.col("k").alias("by_key"))
    tickers = companies.select("ticker", "key")
    if "aliases" in companies.columns:
        tickers = tickers.unionByName(companies.select(F.explode("aliases").alias("ticker"), "key"))
    variants = lambda df, c: df.select("query", F.posexplode(ticker_variants(F.col(c))).alias("pos", "ticker")).join(tickers, "ticker").groupBy("query").agg(F.min_by("key", "pos").alias("key"))
    by_ticker = variants(q, "c").withColumnRenamed("key", "by_ticker")
    names = name_map(companies)
    by_name = q.join(names.withColumnRenamed("name_key", "nk"), "nk").select("query", F.col("keys").alias("by_name"))
    out = q.select("query", "c", "nk").join(by_key, "query", "left").join(by_ticker, "query", "left").join(by_name, "query", "left")
    if aliases is not None:
        named = q.join(aliases.select(normalize_name(F.col("alias")).alias("nk"), F.col("ticker").alias("at")), "nk").select("query", "at")
        out = out.join(variants(named, "at").withColumnRenamed("key", "by_alias"), "query", "left")
    else:
        out = out.withColumn("by_alias", F.lit(None).cast("string"))
    found = F.coalesce("by_key", "by_ticker", F.when(F.size("by_name") == 1, F.col("by_name")[0]), F.when(F.size("by_name") > 1, F.lit("")), "by_alias")
    out = out.withColumn("found", found)
    open_q = out.where("found is null and nk <> ''").select("query", "nk")
    held = holders(open_q.select(F.col("nk").alias("needle")), names.select(F.col("name_key").alias("name"))).withColumnsRenamed({"needle": "nk", "name": "name_key"})
    parts = open_q.join(held, "nk").join(names, "name_key").select("query", F.explode("keys").alias("key")).groupBy("query").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key"))
    out = out.join(parts.where("n = 1").select("query", F.col("key").alias("by_part")), "query", "left")
    key = F.when(F.col("found") != "", F.col("found")).when(F.col("found").isNull(), F.col("by_part"))
    method = F.when(F.col("by_key").isNotNull(), "key").when(F.col("by_ticker").isNotNull(), "ticker").when(F.size("by_name") == 1, "name").when(F.size("by_name") > 1, None).when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_part").isNotNull(), "part")
    error = F.when(F.col("c") == "", "empty").when(F.size("by_name") > 1, F.when(F.coalesce("by_key", "by_ticker").isNull(), "ambiguous")).when(key.isNull(), "unknown")
    return out.select("query", key.alias("key"), method.alias("method"), error.alias("error"))


def autocomplete(queries: DataFrame, companies: DataFrame, limit: int = 10) -> DataFrame:
    """(query, rank, key, priority): tickers that equal or begin with a query, names that begin with or hold it; then common stock before others, large before small, short names first.

    Tickers meet queries on each of their beginnings, names on grams (see holders), so neither side is compared with all of the other.
    """
    q, how = counted(queries.select("query").distinct().withColumns({"code": normalize_ticker(F.col("query")), "needle": normalize_name(F.col("query"))}).where("trim(query) <> ''"))
    c = companies.withColumn("n", normalize_name(F.col("name")))
    cap = F.coalesce("market_cap", F.lit(0.0)) if "market_cap" in companies.columns else F.lit(0.0)
    hint = F.col("rank_hint") if "rank_hint" in companies.columns else F.lit(0)
    c = c.select("key", "ticker", "name", "n", cap.alias("cap"), hint.alias("hint"))
    starts = c.withColumn("code", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("ticker"))), lambda i: F.substring("ticker", F.lit(1), i)))).where("code <> ''")
    by_ticker = q.hint(how).join(starts, "code")
    held = holders(q.select("needle"), c.select(F.col("n").alias("name"))).withColumnRenamed("name", "n")
    by_name = q.hint(how).join(held, "needle").join(c.hint("merge"), "n")
    hits = by_ticker.unionByName(by_name).distinct()
    p = F.when(F.col("ticker") == F.col("code"), 0).when((F.col("code") != "") & F.startswith("ticker", F.col("code")), 1).when(F.startswith("n", F.col("needle")), 2).otherwise(3)
    order = Window.partitionBy("query").orderBy("priority", "hint", F.desc("cap"), F.length("name"), "key")
    return hits.withColumn("priority", p).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "rank", "key", "priority")


def search_symbols(queries: DataFrame, kr: DataFrame, us: DataFrame, limit: int = 8) -> DataFrame:
    """(query, rank, market, key): Korean companies first, the US half as many, cut to a limit."""
    both = autocomplete(queries, kr, limit).withColumn("market", F.lit("KR")).unionByName(autocomplete(queries, us, max(1, limit // 2)).withColumn("market", F.lit("US")))
    order = Window.partitionBy("query").orderBy(F.when(F.col("market") == "KR", 0).otherwise(1), "rank")
    return both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).select("query", F.col("r").alias("rank"), "market", "key")


def route_symbol(c: Column) -> Column:
    """struct(symbol, base, market): six digits or a suffix .KS or .KQ are Korean, all else is US."""
    s = normalize_ticker(c)
    base = F.regexp_replace(s, r"\.(KS|KQ)$", "")
    kr = s.rlike(r"\.(KS|KQ)$") | s.rlike(r"^\d{6}$")
    return F.struct(s.alias("symbol"), base.alias("base"), F.when(kr, "KR").otherwise("US").alias("market"))


def quote_candidates(c: Column) -> Column:
    """Symbols to ask a quote for, in order."""
    r = route_symbol(c)
    return F.when((r["market"] == "KR") & (r["symbol"] == r["base"]), F.array(F.concat(r["base"], F.lit(".KS")), F.concat(r["base"], F.lit(".KQ")))).otherwise(F.array(r["symbol"]))
