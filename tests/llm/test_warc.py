import base64
import gzip
import hashlib

import pytest

from formlake.llm import warc

HTML = "<p>é\r\n\r\nWARC/1.0\r\nfiledesc://\n</p>"


def check(spark, rows, min_bytes=0):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, http string")
    got = sorted((tuple(r) for r in warc.archived_pages(df.repartition(3), min_bytes=min_bytes).collect()), key=str)
    largest = {}
    for i, _, html in rows:
        body = (html or "").encode()
        largest[body] = max(largest.get(body), i, key=lambda x: -1 if x is None else x)
    want, responses = [], set()
    for i, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        top = len(body) < min_bytes or (i == largest[body] and body not in responses)
        if len(body) >= min_bytes and top:
            responses.add(body)
        want.append((i, len(body), digest, "response" if top else "revisit", None if top else largest[body]))
    assert got == sorted(want, key=str)


ROWS = [
    (1, "http://a.net/1", HTML), (2, None, None), (3, "", ""), (4, "http://a b\nc/\t", "same"), (5, "http://x", "same"),
    (5, "http://x", "same"), (7, "u", HTML + " "), (8, "u", "y" * 300_000), (9, "v", HTML), (10, "w", "HTTP/1.1 200 OK\r\n\r\nz"),
    (None, "n", "null id"),
]


def test_round_trip_of_hard_pages(spark):
    check(spark, ROWS)
    check(spark, ROWS, min_bytes=10)
    check(spark, [])


def test_pages_table(spark, table):
    check(spark, table("pages", "page_id", "url", "html"))


ARC1 = b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain 7\n1 0 me\n\n"
ARC2 = b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 x.arc 7\n2 0 me\n\n"


def test_versions_differ_in_their_header_lines():
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhi\n\nthere"
    for first, line in (
        (ARC1, b"http://h/a b 1.2.3.4 20010203040506 text/html %d\n"),
        (ARC2, b"http://h/a b 1.2.3.4 20010203040506 text/html 200 sum - 77 x.arc %d\n"),
    ):
        raw = first + line % len(body) + body + b"\n" + line % 2 + b"xy\n"
        members = gzip.compress(first) + gzip.compress(raw[len(first):])  # one member per record, as archives have
        for content in (raw, gzip.compress(raw), members):
            records = list(warc.arc_records(warc.Stream(content)))
            assert [(r.url, r.date, r.mime, r.block) for r in records] == [
                ("http://h/a b", "20010203040506", "text/html", body), ("http://h/a b", "20010203040506", "text/html", b"xy")]
            assert warc.split_http(records[0].block)[1] == b"hi\n\nthere" and warc.split_http(b"xy") == (b"", b"xy")


def test_broken_archives_are_errors():
    for content in (b"no version\n", ARC1.replace(b"1 0", b"9 0"), ARC1 + b"u 1 2 text/html 99\nshort", ARC1 + b"u x\n"):
        with pytest.raises(ValueError):
            list(warc.arc_records(warc.Stream(content)))


def test_written_records_are_whole(spark, tmp_path):
    arc, out = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    df = spark.createDataFrame([(1, "http://a", "one"), (2, "http://b", "one")], "page_id long, url string, html string")
    warc.write_arc(df.coalesce(1), arc)
    warc.convert_arc(spark, arc, out)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("*.gz"))
    records = list(warc.warc_records(warc.Stream(raw)))
    assert [r[0]["warc-type"] for r in records].count("warcinfo") == 1
    first, second = sorted((r for r in records if "warc-target-uri" in r[0]), key=lambda r: r[0]["warc-target-uri"])
    assert first[0]["warc-type"] == "revisit" and first[0]["warc-profile"] == warc.PROFILE
    assert first[0]["warc-refers-to"] == second[0]["warc-record-id"] != first[0]["warc-record-id"]
    assert second[0]["warc-date"] == "2024-01-01T00:00:00Z" and second[1].endswith(b"\r\n\r\none")
    assert second[0]["warc-block-digest"] == "sha1:" + warc.payload_digest(second[1])
    assert raw.endswith(b"\r\n\r\n")


def test_types_of_legacy_records(spark, tmp_path):
    """A dns answer, a page without an HTTP header, chunked answers with equal payloads, a short date."""
    (tmp_path / "arc").mkdir()
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nhi\r\n0\r\n\r\n"
    blocks = [
        (b"dns:h", b"20010203040506", b"text/dns", b"20010203\nh 60 IN A 1.2.3.4\n"), (b"http://old", b"200102", b"no-type", b"<p>"),
        (b"http://a", b"20010203040506", b"text/html", chunked), (b"http://b", b"20010203040506", b"text/html", chunked),
        (b"dns:i", b"20010203040506", b"text/dns", b"20010203\nh 60 IN A 1.2.3.4\n"),
    ]
    raw = ARC1 + b"".join(b"%s 1.2.3.4 %s %s %d\n%s\n" % (u, d, m, len(b), b) for u, d, m, b in blocks)
    (tmp_path / "arc" / "x.arc.gz").write_bytes(gzip.compress(raw))
    out = f"file://{tmp_path}/warc"
    warc.convert_arc(spark, f"file://{tmp_path}/arc", out)
    written = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("*.gz"))
    records = {r[0].get("warc-target-uri"): r for r in warc.warc_records(warc.Stream(written))}
    info = records.pop(None)
    assert info[0]["warc-type"] == "warcinfo" and info[0]["warc-filename"] == "x.arc.gz" and info[1] == b"1 0 me\n"
    assert info[0]["warc-date"] == "2001-01-01T00:00:00Z" and "warc-payload-digest" not in info[0]
    kinds = {u: (r[0]["warc-type"], r[0]["content-type"]) for u, r in records.items()}
    assert kinds["dns:h"] == kinds["dns:i"] == ("resource", "text/dns")
    assert kinds["http://old"] == ("resource", "application/octet-stream")
    assert records["http://old"][0]["warc-date"] == "2001-02-01T00:00:00Z" and records["http://old"][1] == b"<p>"
    assert {kinds["http://a"], kinds["http://b"]} == {(k, "application/http; msgtype=response") for k in ("response", "revisit")}
    sizes = sorted((r.record_type, r.payload_bytes) for r in warc.read_warc(spark, out).collect())
    dns, body = len(blocks[0][3]), len(warc.split_http(chunked)[1])
    assert sizes == [("resource", 3), ("resource", dns), ("resource", dns), ("response", body), ("revisit", body), ("warcinfo", 7)]


def test_revisits_of_other_writers(spark, tmp_path):
    """A revisit without any length has none; one with a Content-Length of its HTTP header has that."""
    (tmp_path / "w").mkdir()
    raw = b""
    for block in (b"", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n"):
        raw += (b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:x>\r\nWARC-Refers-To: <urn:y>\r\n"
                b"Content-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block))
    (tmp_path / "w" / "x.warc").write_bytes(raw)
    rows = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert [(r.payload_bytes, r.payload_digest, r.refers) for r in rows] == [(None, None, "urn:y"), (9, None, "urn:y")]
