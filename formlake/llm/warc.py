"""Legacy archives: ARC files of version 1 and 2 are parsed and converted into WARC 1.0 files.

An ARC record is a header line, whose fields depend on the version that the file's first record declares, and
as many bytes as its last field says. Conversion gives each record a WARC-Record-ID (from the file and the
place in it), a WARC-Date, a WARC-Type and a payload digest. The version block becomes a warcinfo record, records
without an HTTP header (``dns:`` answers and the like) are resources of their own content type, the others
are responses. Of the responses with equal payloads one is kept, the others are revisits without the payload
that refer to it; the payload's length is a header field of theirs.

Archives are written by Spark's text writer, which puts the bytes of a string out as they are, as gzip files;
they are read as binary files and unpacked record by record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.llm.common import distinct_names, sized, store
from formlake.session import scratch_path

# Names of the fields of an ARC header line, by version.
ARC_FIELDS = {
    b"1": ("url", "ip", "date", "type", "length"),
    b"2": ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Revisits carry the length of the payload that they leave out; readers skip fields that they don't know.
LENGTH_FIELD = "WARC-Payload-Length"
READ_BYTES = 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- reading


class Stream:
    """Bytes of a gzip file (any number of members) or a plain one, a piece at a time."""

    def __init__(self, content: bytes | memoryview):
        self.content, self.at = memoryview(content), 0
        self.gzip = bytes(self.content[:2]) == b"\x1f\x8b"
        self.unpacker = zlib.decompressobj(31) if self.gzip else None
        self.held, self.begin, self.offset = bytearray(), 0, 0

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        raw = self.content[self.at:self.at + READ_BYTES]
        self.at += len(raw)
        if self.gzip:
            raw = bytes(raw)
            while raw:
                if self.unpacker.eof:
                    self.unpacker = zlib.decompressobj(31)
                self.held += self.unpacker.decompress(raw)
                raw = self.unpacker.unused_data
        else:
            self.held += raw
        return True

    def _cut(self, n: int) -> bytes:
        out = bytes(self.held[self.begin:self.begin + n])
        self.begin += n
        self.offset += n
        if self.begin > READ_BYTES:
            del self.held[:self.begin]
            self.begin = 0
        return out

    def line(self) -> bytes | None:
        """Up to and with the next newline; None at the end."""
        seen = self.begin
        while (k := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            before = self.begin
            if not self._more():
                rest = len(self.held) - self.begin
                return self._cut(rest) if rest else None
            seen -= before - self.begin
        return self._cut(k + 1 - self.begin)

    def take(self, n: int) -> bytes:
        """The next n bytes; an error if the file is cut off."""
        while len(self.held) - self.begin < n and self._more():
            pass
        if len(self.held) - self.begin < n:
            raise ValueError(f"the archive ends within a record at {self.offset}")
        return self._cut(n)


@dataclass
class ArcRecord:
    offset: int
    url: str
    date: str
    mime: str
    block: bytes  # HTTP header and payload, as declared


    @property
    def kind(self) -> str:
        """The WARC type that the record has by itself."""
        if self.url.startswith("filedesc:"):
            return "warcinfo"
        return "response" if split_http(self.block)[0] else "resource"


def _named(line: bytes, fields: tuple[str, ...], offset: int) -> dict[str, str]:
    # The URL is the first field and may itself hold blanks in old files.
    parts = line.rsplit(b" ", len(fields) - 1)
    if len(parts) != len(fields) or not parts[-1].isdigit():
        raise ValueError(f"not an ARC header line at {offset}")
    return dict(zip(fields, (p.decode("utf-8", "replace") for p in parts), strict=True))


def arc_records(stream: Stream, version_block: bool = False) -> Iterator[ArcRecord]:
    """The records behind the version block, by their declared lengths; on request the version block too."""
    fields: tuple[str, ...] | None = None
    while True:
        offset = stream.offset
        line = stream.line()
        if line is None:
            return
        line = line.rstrip(b"\r\n")
        if not line:
            continue  # records are parted by newlines
        if fields is None:
            if not line.startswith(b"filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            block = stream.take(int(line.rsplit(b" ", 1)[1]))
            version = block.split(b" ", 1)[0]
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version!r}")
            fields = ARC_FIELDS[version]
            if version_block:
                named = _named(line, fields, offset)
                yield ArcRecord(offset, named["url"], named["date"], named["type"], block)
            continue
        named = _named(line, fields, offset)
        yield ArcRecord(offset, named["url"], named["date"], named["type"], stream.take(int(named["length"])))


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with the empty line that ends it) and payload."""
    end = block.find(b"\r\n\r\n")
    return (block[:end + 4], block[end + 4:]) if block.startswith(b"HTTP/") and end >= 0 else (b"", block)


def headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip())
    return out


def warc_records(stream: Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, by the declared lengths."""
    while True:
        line = stream.line()
        if line is None:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record at {stream.offset}")
        own = bytearray()
        while (line := stream.line()) not in (b"\r\n", b"\n", None):
            own += line
        named = headers(bytes(own))
        yield named, stream.take(int(named["content-length"]))


# ---- Spark: ARC


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("string")


def write_arc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes pages as ARC files of version 1, one per task; the id travels in the HTTP header.

    Blanks and line ends in URLs are percent-encoded, as the header line needs. Null html is empty.
    """
    pages = distinct_names(df, page_id=id_col, url=url_col, html=html_col)
    url = F.coalesce("url", F.lit(""))
    for char in (" ", "\t", "\n", "\r", "\x0b", "\x0c"):
        url = F.replace(url, F.lit(char), F.lit(f"%{ord(char):02X}"))
    html = F.coalesce("html", F.lit(""))
    number = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), number, F.lit("Content-Length: "),
        _bytes(html), F.lit("\r\n\r\n"))
    block = F.concat("http", "html")
    line = F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit("20240101000000"), F.lit("text/html"), _bytes(F.col("block")))
    body = "1 0 formlake\nURL IP-address Archive-date Content-type Archive-length\n"
    first = f"filedesc://pages.arc 0.0.0.0 20240101000000 text/plain {len(body)}\n{body}"
    rows = pages.select(url.alias("url"), html.alias("html"), http.alias("http")).select("url", block.alias("block"))
    rows = rows.select(F.concat(line, F.lit("\n"), "block").alias("value"))

    def with_version(batches):
        begun = False
        for batch in batches:
            if not begun:
                yield pa.RecordBatch.from_arrays([pa.array([first], batch.schema.field(0).type)], ["value"])
                begun = True
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    rows.mapInArrow(with_version, "value string").write.option("compression", "gzip").text(path, lineSep="\n")


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.format("binaryFile").load(path).select(name.alias("file"), "content")


def record_id(file: str, offset: int) -> str:
    """The same for every reading of the same file."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{file}:{offset}')}"


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], limit: int = 4 << 20):
    """Record batches of bounded size; each row's last value is its size in bytes."""
    held, size = [], 0
    for *row, own in rows:
        held.append(row)
        size += own + 200
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


_COMMON = ["file", "record_id", "kind", "mime", "url", "date", "digest", "payload_bytes", "page_id"]
_COMMON_TYPES = [pa.string()] * 7 + [pa.int64(), pa.string()]
_COMMON_DDL = (
    "file string, record_id string, kind string, mime string, url string, date string, digest string, payload_bytes long, "
    "page_id string")


def _parsed(whole: bool):
    def rows(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for r in arc_records(Stream(content.as_buffer()), version_block=True):
                    http, payload = split_http(r.block)
                    kind = "response" if http else r.kind
                    own = [file, record_id(file, r.offset), kind, r.mime, r.url, r.date, payload_digest(payload),
                           len(payload), headers(http).get("x-page-id")]
                    yield (*own, http, payload, len(r.block)) if whole else (*own, 0)

    def parse(batches):
        names = [*_COMMON, "http", "payload"] if whole else _COMMON
        types = [*_COMMON_TYPES, pa.binary(), pa.binary()] if whole else _COMMON_TYPES
        yield from _batched(rows(batches), names, types)

    return parse


def read_arc(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """The records of ARC files, version blocks included: file, record_id, kind (warcinfo, response or resource),
    mime (the ARC's own type), url, date, digest, payload_bytes, page_id (null if there is no such HTTP header),
    and http and payload unless only the others are asked for."""
    ddl = _COMMON_DDL + (", http binary, payload binary" if whole else "")
    return _files(spark, path).mapInArrow(_parsed(whole), ddl)


# ---- Spark: WARC


def warc_date(date: str) -> str:
    """An ARC date of up to 14 digits as a WARC date; digits that are missing are those of the first second."""
    digits = date[:14] if date.isdigit() else ""
    digits += "19700101000000"[len(digits):]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def _warc_text(record: dict, first_id: str | None) -> bytes:
    """One record, up to but without its last newline."""
    http, payload, kind = record["http"], record["payload"], record["kind"]
    revisit = first_id is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.0", f"WARC-Type: {'revisit' if revisit else kind}", f"WARC-Record-ID: <{record['record_id']}>",
        f"WARC-Date: {warc_date(record['date'])}",
        f"WARC-Filename: {record['file']}" if kind == "warcinfo" else f"WARC-Target-URI: {record['url']}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
    ]
    if kind != "warcinfo":
        lines.append(f"WARC-Payload-Digest: sha1:{record['digest']}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{first_id}>", f"{LENGTH_FIELD}: {len(payload)}"]
    own = record["mime"] if "/" in record["mime"] else "application/octet-stream"
    content_type = "application/http; msgtype=response" if kind == "response" else own
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r"


def _writer(batches):
    def rows():
        for batch in batches:
            for r in batch.to_pylist():
                text = _warc_text(r, r["first_id"])
                yield text, len(text)

    yield from _batched(rows(), ["value"], [pa.binary()])


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """Writes the records of ARC files as WARC files.

    Version blocks become warcinfo records, records without an HTTP header resources. Of the responses with equal payloads of at least ``min_bytes`` bytes, that with the largest page id (no
    id counts as the least; then the largest record id) is the response, the others revisit it. Payloads are
    compared by digest and length. The table of repeated payloads is broadcast if it is small.
    """
    keys = store(read_arc(spark, arc_path, whole=False), "arc-records")
    # Ids are numbers here; the archive carries them as text.
    last = Window.partitionBy("digest", "payload_bytes").orderBy(
        F.expr("try_cast(page_id AS decimal(38,0))").desc_nulls_last(), F.desc("record_id"))
    often = (
        keys.where((F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes)).groupBy("digest", "payload_bytes")
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    among = keys.where("kind = 'response'").join(sized(often), ["digest", "payload_bytes"])
    ranked = among.withColumn("place", F.row_number().over(last)).where("place = 1")
    first = store(ranked.select("digest", "payload_bytes", F.col("record_id").alias("first")), "responses")
    whole = read_arc(spark, arc_path).join(sized(first), ["digest", "payload_bytes"], "left")
    refers = F.when((F.col("kind") == "response") & (F.col("first") != F.col("record_id")), F.col("first"))
    rows = whole.select(
        "file", "record_id", "kind", "mime", "url", "date", "digest", "http", "payload", refers.alias("first_id"))
    texts = rows.mapInArrow(_writer, "value binary").select(F.col("value").cast("string").alias("value"))
    texts.write.option("compression", "gzip").text(warc_path, lineSep="\n")


def _warc_reader(batches):
    def rows():
        for batch in batches:
            for content in batch.column(1):
                for named, block in warc_records(Stream(content.as_buffer())):
                    kind = named["warc-type"]
                    http, payload = split_http(block) if kind in ("response", "revisit") else (b"", block)
                    own = headers(http)
                    digest = named.get("warc-payload-digest")
                    digest = digest and digest.removeprefix("sha1:")
                    if kind != "revisit" and digest and payload_digest(payload) != digest:
                        raise ValueError(f"payload of {named['warc-record-id']} doesn't match its digest")
                    length = named.get(LENGTH_FIELD.lower(), own.get("content-length", ""))
                    size = len(payload) if kind != "revisit" else int(length) if length.isdigit() else None
                    refers = named.get("warc-refers-to")
                    yield (own.get("x-page-id"), named["warc-record-id"].strip("<>"), kind, digest, size,
                           refers.strip("<>") if refers else None, 0)

    yield from _batched(
        rows(), ["page_id", "record_id", "record_type", "payload_digest", "payload_bytes", "refers"],
        [pa.string()] * 4 + [pa.int64(), pa.string()])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: page_id, record_id, record_type, payload_digest (null if the record has none),
    payload_bytes, refers (a record id). Digests of payloads are checked. A revisit's length is its own header field,
    else the Content-Length of its HTTP header, else null."""
    return _files(spark, path).mapInArrow(
        _warc_reader, "page_id string, record_id string, record_type string, payload_digest string, payload_bytes long, "
                      "refers string")


def archived_pages(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Pages through ARC and WARC files and back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    payload_digest is the bare upper-case base32 SHA-1 of the html in UTF-8 (null: empty), refers_to the page_id of
    the response that a revisit refers to. Repeated rows are records of their own, one of which is the
    response. A null id stays null. An empty table gives an empty table. Extra columns are ignored.
    """
    spark = df.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(df, arc, id_col, url_col, html_col)
    convert_arc(spark, arc, warc, min_bytes)
    records = store(read_warc(spark, warc).where("record_type IN ('response', 'revisit')"), "warc-records")
    kind = df.select(df[id_col]).schema[0].dataType
    records = records.withColumn("page_id", F.col("page_id").cast(kind))
    targets = records.where("refers is not null").select("refers").distinct()
    named = records.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    named = named.join(targets, "refers", "left_semi")
    return records.join(named, "refers", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
