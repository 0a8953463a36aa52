"""Legacy ARC archives and their conversion to WARC."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import saved, small, workspace

#: Payloads from this size on are stored once; date of pages that have none.
REVISIT_BYTES, DATE = 1000, "20240101000000"
#: The header line that names the rows' fields, by version of the format (fixed values).
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def text_file(df: DataFrame, record: Column, path: str, sep: str) -> None:
    """Writes one string a row, each followed by sep, gzipped, a file for each partition."""
    df.select(record.alias("value")).write.option("lineSep", sep).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Pages as ARC files of versions 1 and 2 in turn: a version block, then for each page its header line and an HTTP response.

    A null html is an empty payload, a null url reads "urn:none", white space in a url is escaped; a null page_id leaves out the X-Row-Id header.
    """
    number = F.monotonically_increasing_id()
    version = F.shiftrightunsigned(number, 33) % 2 + 1
    first = number.bitwiseAND((1 << 33) - 1) == 0
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    row = F.coalesce(F.concat(F.lit("X-Row-Id: "), F.col(f"`{page_id}`").cast("string"), F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), row, F.lit("Content-Length: "), F.octet_length(body), F.lit("\r\n\r\n"), body)
    link = F.regexp_replace(F.coalesce(F.col(f"`{url}`"), F.lit("urn:none")), r"\s", "%20")
    pages = pages.select(version.alias("v"), first.alias("first"), http.alias("http"), link.alias("link"))
    about = F.when(F.col("v") == 1, F.lit(f"1 0 tidemark\n{FIELDS[1]}\n")).otherwise(F.lit(f"2 0 tidemark\n{FIELDS[2]}\n"))
    middle = lambda size: F.when(F.col("v") == 1, F.concat(F.lit(" "), size)).otherwise(F.concat(F.lit(" 200 - - 0 - "), size))
    head = F.concat(F.lit(f"filedesc://pages.arc 0.0.0.0 {DATE} text/plain"), middle(F.octet_length(about)), F.lit("\n"), about, F.lit("\n"))
    line = F.concat("link", F.lit(f" 0.0.0.0 {DATE} text/html"), middle(F.octet_length("http")), F.lit("\n"), "http")
    text_file(pages, F.concat(F.when(F.col("first"), head).otherwise(F.lit("")), line), path, "\n")


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file: url, ip, date, mime, body (of declared length). The version block says which fields a header line has.

    Fields are taken from the end of a line, as a url may hold spaces. A record that reaches beyond the file is an error.
    """
    at, fields = 0, 5
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        if not line:
            at = end + 1 if end >= 0 else len(data)
            continue
        if line.startswith("filedesc:"):  # the block after it names version and fields; its own line has as many
            block = data[end + 1 :].split(b"\n", 2)
            fields = len(block[1].split())
        parts = line.rsplit(" ", fields - 1)
        size = int(parts[-1])
        if len(parts) != fields or end + 1 + size > len(data):
            raise ValueError(f"bad ARC record at byte {at}: {line[:200]}")
        yield {"url": parts[0], "ip": parts[1], "date": parts[2], "mime": parts[3], "body": data[end + 1 : end + 1 + size]}
        at = end + 1 + size


def http_parts(body: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(head with its blank line, payload, header fields in lower case) of an HTTP response; other bodies are all payload."""
    end = body.find(b"\r\n\r\n") if body.startswith(b"HTTP/") else -1
    head = body[: end + 4] if end >= 0 else b""
    lines = head.decode("latin-1").split("\r\n")[1:]
    return head, body[len(head) :], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def files(path: str, spark) -> DataFrame:
    """The files that Spark has written to a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def inflated(data: bytes) -> bytes:
    """A gzipped file of one or more members, as archives with a member for each record are, or a plain one."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data


def convert(arcs: DataFrame, with_body: bool = True) -> DataFrame:
    """A row for each record of ARC files (content): row_id, url, ip, date (as WARC writes it), mime, kind, digest (hex SHA-1), payload_bytes and, unless left out, head and body.

    Version blocks become warcinfo, HTTP responses become response, all else becomes resource.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in parse_arc(inflated(content.as_py())):
                    head, payload, http = http_parts(r["body"])
                    d = r["date"].ljust(14, "0")
                    row = {"row_id": int(http["x-row-id"]) if "x-row-id" in http else None, "url": r["url"], "ip": r["ip"], "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", "mime": r["mime"], "kind": "warcinfo" if r["url"].startswith("filedesc:") else "response" if head else "resource", "digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)}
                    rows.append(row | ({"head": head, "body": r["body"]} if with_body else {}))
                    held += with_body and len(r["body"])
                    if len(rows) >= 2000 or held > 16_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    names = {"row_id": "long", "url": "string", "ip": "string", "date": "string", "mime": "string", "kind": "string", "digest": "string", "payload_bytes": "long"} | ({"head": "binary", "body": "binary"} if with_body else {})
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in names.items()])
    return arcs.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in names.items()))


def record_id(row_id: Column, digest: Column) -> Column:
    """A version-8 UUID that holds a row's 64-bit id and 56 bits of its payload's digest."""
    p = F.lower(F.lpad(F.hex(row_id), 16, "0"))
    piece = lambda c, at, n: F.substring(c, at, n)
    return F.concat(piece(p, 1, 8), F.lit("-"), piece(p, 9, 4), F.lit("-8"), piece(p, 13, 3), F.lit("-8"), piece(p, 16, 1), piece(digest, 1, 2), F.lit("-"), piece(digest, 3, 12))


def held_id(name: str) -> int | None:
    """The row's id that a record's UUID holds; null for a UUID of another version."""
    x = uuid.UUID(name)
    if x.version != 8:
        return None
    n = int(x.hex[:12] + x.hex[13:16] + x.hex[17], 16)
    return n - (1 << 64) if n >> 63 else n


def write_warc(arcs: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """ARC files (content) as WARC 1.1 files: response, resource, warcinfo, and revisit records for repeated payloads.

    Of responses with equal payloads (by length and SHA-1) of at least revisit_bytes, that with the largest row_id is stored; the others revisit it. Rows
    without row_id get a UUID of their digest and url. Digests of repeated payloads are found in a first pass that moves no payload; they
    are broadcast if a count shows them to be few, else joined by shuffle.
    """
    seen = convert(arcs, with_body=False).where((F.col("kind") == "response") & (F.col("payload_bytes") >= revisit_bytes))
    again = seen.groupBy("digest", "payload_bytes").agg(F.max("row_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null")
    again = small(saved(again.select("digest", "payload_bytes", "kept", F.lit("response").alias("kind"))))
    rows = convert(arcs).join(again, ["digest", "payload_bytes", "kind"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("row_id").eqNullSafe(F.col("kept"))
    plain = F.sha1(F.concat("digest", F.lit(" "), "url"))
    name = F.when(F.col("row_id").isNotNull(), record_id(F.col("row_id"), F.col("digest"))).otherwise(F.concat(F.substring(plain, 1, 8), F.lit("-"), F.substring(plain, 9, 4), F.lit("-5"), F.substring(plain, 14, 3), F.lit("-8"), F.substring(plain, 18, 3), F.lit("-"), F.substring(plain, 21, 12)))
    block = F.when(revisit, F.col("head")).otherwise(F.col("body"))
    field = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    http = F.col("kind") == "response"
    lines = [
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("kind"))),
        field("WARC-Record-ID", urn(name)),
        field("WARC-Date", F.col("date")),
        F.when(F.col("kind") != "warcinfo", field("WARC-Target-URI", F.col("url"))),
        F.when(http, field("WARC-IP-Address", F.col("ip"))),
        F.when(http, field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block))),
        F.when(revisit, field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.when(revisit, field("WARC-Refers-To", urn(record_id(F.col("kept"), F.col("digest"))))),
        field("Content-Type", F.when(http, F.lit("application/http; msgtype=response")).when(F.col("kind") == "warcinfo", F.lit("application/warc-fields")).otherwise(F.col("mime"))),
        field("Content-Length", F.octet_length(block).cast("string")),
    ]
    text_file(rows, F.concat(F.concat_ws("\r\n", *lines).cast("binary"), F.lit("\r\n\r\n").cast("binary"), block).cast("string"), path, "\r\n\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not head[0].startswith("WARC/"):
            raise ValueError(f"bad WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def read_warc(warcs: DataFrame) -> DataFrame:
    """A row for each response or revisit of WARC files (content): row_id, url, record_type, payload_bytes, payload_digest, refers_to (row_id), payload (null in a revisit).

    Digests of blocks and of stored payloads are computed again; a difference is an error.
    """
    schema = pa.schema([("row_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in parse_warc(inflated(content.as_py())):
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    _, payload, http = http_parts(block)
                    revisit, digest = f["warc-type"] == "revisit", f["warc-payload-digest"].removeprefix("sha1:")
                    if "sha1:" + hashlib.sha1(block).hexdigest() != f["warc-block-digest"] or not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"digests of {f['warc-record-id']} differ from what is stored")
                    rows.append({"row_id": int(http["x-row-id"]) if "x-row-id" in http else None, "url": f["warc-target-uri"], "record_type": f["warc-type"], "payload_bytes": int(http["content-length"]), "payload_digest": digest, "refers_to": held_id(f["warc-refers-to"][10:-1]) if revisit else None, "payload": None if revisit else payload})
                    held += len(payload)
                    if len(rows) >= 2000 or held > 16_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return warcs.mapInArrow(run, "row_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archived(pages: DataFrame, **names: str) -> DataFrame:
    """Pages written as ARC, converted to WARC, and read back (see read_warc). An empty table gives an empty one."""
    spark = pages.sparkSession
    arc, warc = (f"{workspace(spark)}/{uuid.uuid4().hex}.{kind}" for kind in ("arc", "warc"))
    write_arc(pages, arc, **names)
    write_warc(files(arc, spark), warc)
    return read_warc(files(warc, spark))
