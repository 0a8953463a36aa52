"""Archives: parsing, round trip, revisits."""

import gzip
import hashlib

import pytest

from tidemark.llm.archives import FIELDS, archived, files, held_id, http_parts, inflated, parse_arc, parse_warc, read_warc, write_warc


def test_versions_of_arc():
    one = f"1 0 x\n{FIELDS[1]}\n".encode()
    two = f"2 0 x\n{FIELDS[2]}\n".encode()
    data = b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(one) + one + b"\nhttp://a/b c 1.2.3.4 19990101120000 text/html 5\nh\nllo\n"
    got = list(parse_arc(data))
    assert got[1] == {"url": "http://a/b c", "ip": "1.2.3.4", "date": "19990101120000", "mime": "text/html", "body": b"h\nllo"}
    data = b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain 200 - - 0 a.arc %d\n" % len(two) + two + b"\nhttp://a/ 1.2.3.4 19990101120000 text/html 404 - - 77 a.arc 3\nabc\n"
    assert list(parse_arc(data))[1]["body"] == b"abc"
    with pytest.raises(ValueError, match="bad ARC record"):
        list(parse_arc(data.replace(b" 3\n", b" 30\n")))


def test_helpers():
    assert http_parts(b"HTTP/1.1 200 OK\r\nX-Row-Id: 4\r\n\r\nbody")[1:] == (b"body", {"x-row-id": "4"})
    assert http_parts(b"raw")[:2] == (b"", b"raw") and inflated(b"plain") == b"plain"
    assert list(parse_warc(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")) == [({"content-length": "2"}, b"ab")]
    assert held_id("00000000-0000-8000-8500-000000000000") == 5 and held_id("ffffffff-ffff-8fff-8f00-000000000000") == -1


def test_round_trip(spark):
    big = "<p>" + "wörd\r\n\r\n" * 300 + "WARC/1.1\r\n</p>"
    rows = [(1, "http://a/1", big, "x"), (2, "http://a/2", big, "x"), (9, None, big, None), (3, "http://a/3", "same", "x"), (4, "a b", "same", "x"), (5, "u", None, "x"), (6, "u", "", "x"), (-7, "u", "y" * 200_000, "x"), (None, "u", "z", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(2)
    got = {r.row_id: r for r in archived(pages).collect()}
    assert len(got) == len(rows)
    for page, _, html, _ in rows:
        body = (html or "").encode()
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if page in (1, 2) else ("response", None))
        assert r.payload == (None if page in (1, 2) else body)
    assert archived(pages.limit(0)).collect() == []


def test_bytes_that_are_no_text_and_a_gzip_member_for_each_record(spark, tmp_path):
    bodies = [bytes(range(256)) * 8, b"latin \xe9\xff\x00\r\n\r\nWARC/1.1\r\n" * 60, bytes(range(256)) * 8]
    about = f"1 0 x\n{FIELDS[1]}\n".encode()
    records = [b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(about) + about + b"\n"]
    for i, body in enumerate(bodies):
        http = b"HTTP/1.0 200 OK\r\nX-Row-Id: %d\r\nContent-Length: %d\r\n\r\n" % (i, len(body)) + body
        records.append(b"http://a/%d 1.2.3.4 19990101120000 text/html %d\n" % (i, len(http)) + http + b"\n")
    packed = b"".join(map(gzip.compress, records))
    assert inflated(packed) == b"".join(records)
    arcs = spark.createDataFrame([(packed,)], "content binary")
    write_warc(arcs, str(tmp_path / "warc"))
    got = {r.row_id: r for r in read_warc(files(str(tmp_path / "warc"), spark)).collect()}
    assert {i: r.payload_digest for i, r in got.items()} == {i: hashlib.sha1(b).hexdigest() for i, b in enumerate(bodies)}
    assert got[0].refers_to == 2 and got[2].payload == bodies[2] and got[1].payload == bodies[1]


def test_repeated_ids_are_records_of_their_own(spark):
    body = "x" * 2000
    pages = spark.createDataFrame([(1, "u", body), (1, "u", body), (1, "v", "short"), (2, "w", body)], "page_id long, url string, html string")
    got = sorted((r.row_id, r.record_type, r.refers_to or 0, r.payload_bytes) for r in archived(pages).collect())
    assert got == [(1, "response", 0, 5), (1, "revisit", 2, 2000), (1, "revisit", 2, 2000), (2, "response", 0, 2000)]
