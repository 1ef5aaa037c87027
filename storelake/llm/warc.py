"""WARC archives from legacy ARC archives.

An ARC file begins with a version block (``filedesc://``) whose first line says the
version; each record is a header line with the fields of that version, the last being the
length in bytes of what follows. The converter reads the records by those lengths, splits
off the HTTP header, and writes WARC records: identifiers derived from what the record
is, timestamps from the 14-digit date, types from the kind of record, and SHA-1 digests
in base 32. Of records with equal payloads the one with the smallest page id is a
response, the others revisit it and carry no payload. Of several with that id the first by
archive and place is the response, so repeated pages revisit each other too.

Archives are files of a few megabytes each, written and read by Spark (one row is one
file, compressed with gzip), so they may be in any store that Spark reaches. What is
shuffled are digests and, once, the compressed files that get their decisions.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelake.session import written

ARCHIVE_BYTES = 4 << 20
#: Fields of a record's header line in either version (fixed values of the ARC format).
FIELDS = {
    "1": ("url", "ip", "date", "mime", "length"),
    "2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename",
          "length"),
}
FIELD_LINES = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
         "Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Made up for pages, which have no date of their own.
PAGE_DATE = "20240101000000"
IDS = uuid.UUID("8c0a3f1e-5a51-4e58-9d0b-0d3f6f7a4b11")


class ArchiveError(ValueError):
    """An archive that does not keep to its format."""


@dataclass
class ArcRecord:
    """A record of an ARC file; ``head`` is the HTTP header, if it has one."""

    offset: int
    url: str
    ip: str
    date: str
    mime: str
    head: bytes
    payload: bytes


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def stamp(date: str) -> str:
    """A WARC date from the 14 digits (or the first 8 or 12 of them)."""
    if not re.fullmatch(r"\d{8}(\d{4}(\d{2})?)?", date):
        raise ArchiveError(f"not an archive date: {date!r}")
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def header_value(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].strip().decode("utf-8", "replace") if found else None


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of ARC files that follow one another, version blocks left out."""
    at, fields = 0, None
    while True:
        while data[at:at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError(f"header line without end at byte {at}")
        line = data[at:end].rstrip(b"\r").decode("utf-8").split(" ")
        try:
            length = int(line[-1])
        except ValueError:
            raise ArchiveError(f"no length in the header line at byte {at}") from None
        body = data[end + 1:end + 1 + length]
        if length < 0 or len(body) < length:
            raise ArchiveError(f"record at byte {at} is shorter than declared")
        start, at = at, end + 1 + length
        if line[0].startswith("filedesc:"):
            version = body.split(b"\n", 1)[0].split(b" ")[0].decode()
            if version not in FIELDS:
                raise ArchiveError(f"unknown ARC version {version!r}")
            fields = FIELDS[version]
            continue
        if fields is None:
            raise ArchiveError("record before the version block")
        if len(line) != len(fields):
            raise ArchiveError(f"header line at byte {start} has {len(line)} fields")
        named = dict(zip(fields, line, strict=True))
        head, payload = b"", body
        if body.startswith(b"HTTP/"):
            split = re.search(rb"\r?\n\r?\n", body)
            head, payload = (body[:split.end()], body[split.end():]) if split else (body, b"")
        yield ArcRecord(start, named["url"], named["ip"], named["date"], named["mime"], head,
                        payload)


def arc_head(name: str, version: str) -> bytes:
    minor = {"1": "0", "2": "0"}[version]
    body = f"{version} {minor} storelake\n{FIELD_LINES[version]}\n\n"
    values = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": PAGE_DATE,
              "mime": "text/plain", "status": "200", "length": str(len(body))}
    return f"{' '.join(values.get(f, '-') for f in FIELDS[version])}\n{body}".encode()


def arc_record(url: str, payload: bytes, page_id: object, version: str) -> bytes:
    """A page as an ARC record: an HTTP response of which the payload is the body."""
    known = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    body = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}"
            f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload
    plain = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    values = {"url": plain or "-", "ip": "0.0.0.0", "date": PAGE_DATE, "mime": "text/html",
              "status": "200", "length": str(len(body))}
    return f"\n{' '.join(values.get(f, '-') for f in FIELDS[version])}\n".encode() + body


def warc_record(kind: str, record_id: str, fields: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>"]
    lines += [f"{k}: {v}" for k, v in fields.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def record_name(path: str, record: ArcRecord) -> str:
    """Page id, digest and place: no two records have one name, whatever their page ids."""
    page = header_value(record.head, b"X-Page-Id") or ""
    return f"{page}:{sha1(record.payload)}:{path}#{record.offset}"


def as_warc(record: ArcRecord, path: str, refers_to: str | None) -> bytes:
    """The record; ``refers_to`` is the name of the record that it revisits, if any."""
    fields = {"WARC-Target-URI": record.url, "WARC-Date": stamp(record.date),
              "WARC-IP-Address": record.ip if record.ip != "0.0.0.0" else None,
              "WARC-Payload-Digest": f"sha1:{sha1(record.payload)}"}
    own = str(uuid.uuid5(IDS, record_name(path, record)))
    if not record.head:
        return warc_record("resource", own, fields | {"Content-Type": record.mime},
                           record.payload)
    fields["Content-Type"] = "application/http;msgtype=response"
    if refers_to is None:
        return warc_record("response", own, fields, record.head + record.payload)
    fields |= {"WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(IDS, refers_to)}>",
               "WARC-Profile": REVISIT_PROFILE}
    return warc_record("revisit", own, fields, record.head)


def warc_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of the records of a WARC file, read by their lengths."""
    at = 0
    while True:
        while data[at:at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end + 2]
        if end < 0 or not head.startswith(b"WARC/"):
            raise ArchiveError(f"no WARC header at byte {at}")
        length = header_value(head, b"Content-Length")
        if length is None or end + 4 + int(length) > len(data):
            raise ArchiveError(f"record at byte {at} is shorter than declared")
        at = end + 4 + int(length)
        yield head, data[end + 4:at]


def unpacked(data: bytes) -> bytes:
    """The content of a file of one or more gzip members; other files as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out += [member.decompress(data), member.flush()]
        data = member.unused_data
    return b"".join(out) if out else data


def _write(archives: DataFrame, path: str) -> None:
    """One file for each row, which is the text of an archive."""
    archives.write.option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).option(
        "lineSep", "\r\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        "path", "content")


def _row(archive: bytes) -> pa.RecordBatch:
    """The bytes as they are; payloads of ARC files may be no text at all."""
    return pa.RecordBatch.from_arrays([pa.array([archive], pa.binary()).view(pa.string())],
                                      ["value"])


def _archives(records: Iterator[bytes], head: bytes, limit: int) -> Iterator[pa.RecordBatch]:
    """Archives of about that many bytes; a longer record makes a longer archive."""
    parts, size = [head], len(head)
    for record in records:
        parts.append(record)
        size += len(record)
        if size >= limit:
            yield _row(b"".join(parts))
            parts, size = [head], len(head)
    if len(parts) > 1:
        yield _row(b"".join(parts))


def write_arc(pages: DataFrame, path: str, version: str = "1", id_col: str = "page_id",
              url_col: str = "url", html_col: str = "html", limit: int = ARCHIVE_BYTES) -> None:
    """Pages as ARC archives of either version.

    Null html is an empty payload, a null url is written as -, white space in a url is
    percent-encoded. A null id is left out. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    piece = batch.slice(start, 64).to_pydict()
                    for page, url, html in zip(piece["page_id"], piece["url"], piece["html"],
                                               strict=True):
                        yield arc_record(url or "", (html or "").encode(), page, version)

        return _archives(records(), arc_head("pages.arc", version), limit)

    _write(rows.mapInArrow(run, "value string"), path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, page_id (text), url, payload_bytes, payload_digest of ARC records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column("path"), batch.column("content"),
                                      strict=True):
                rows = [{"path": place.as_py(), "offset": r.offset,
                         "page_id": header_value(r.head, b"X-Page-Id"), "url": r.url,
                         "payload_bytes": len(r.payload), "payload_digest": sha1(r.payload)}
                        for r in arc_records(unpacked(content.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARC_ROWS)

    return _files(spark, path).mapInArrow(
        run, "path string, offset long, page_id string, url string, payload_bytes long, "
             "payload_digest string")


ARC_ROWS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.string()),
                      ("url", pa.string()), ("payload_bytes", pa.int64()),
                      ("payload_digest", pa.string())])


def revisits(records: DataFrame, least: int) -> DataFrame:
    """path, offset, refers_to (a record name) of the records that repeat a payload.

    Payloads under ``least`` bytes do not count. The first record by page id (as a number),
    path and offset is not one; records without an id refer to it, but none refers to a
    record without an id.
    """
    rows = records.filter(F.col("payload_bytes") >= least).withColumn(
        "place", F.struct(F.expr("try_cast(page_id as bigint)").alias("id"), "path", "offset",
                          "page_id"))
    first = rows.groupBy("payload_digest", "payload_bytes").agg(
        F.min(F.when(F.col("place.id").isNotNull(), F.col("place"))).alias("first"),
        F.count("*").alias("n")).filter("n > 1 and first is not null")
    return rows.join(first, ["payload_digest", "payload_bytes"]).filter(
        "path != first.path or offset != first.offset").select(
        "path", "offset", F.concat("first.page_id", F.lit(":"), "payload_digest", F.lit(":"),
                                   "first.path", F.lit("#"), "first.offset").alias("refers_to"))


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0,
                limit: int = ARCHIVE_BYTES) -> None:
    """Convert all ARC archives of a folder; what has no HTTP header becomes a resource."""
    records = written(read_arc(spark, arc_path), "arc-records")
    repeated = revisits(records, least).groupBy(F.col("path").alias("in_path")).agg(
        F.collect_list(F.struct("offset", "refers_to")).alias("repeats"))
    files = _files(spark, arc_path).join(repeated, F.expr("path = in_path"), "left").select(
        "path", "content", "repeats")
    info = warc_record("warcinfo", str(uuid.uuid5(IDS, "info")), {
        "WARC-Date": stamp(PAGE_DATE), "Content-Type": "application/warc-fields"},
        b"software: storelake\r\nformat: WARC File Format 1.1\r\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def converted() -> Iterator[bytes]:
            for batch in batches:
                for place, content, repeats in zip(*batch.columns, strict=True):
                    refers = {r["offset"]: r["refers_to"] for r in repeats.as_py() or ()}
                    for record in arc_records(unpacked(content.as_py())):
                        yield as_warc(record, place.as_py(), refers.get(record.offset))

        return _archives(converted(), info, limit)

    _write(files.mapInArrow(run, "value string"), warc_path)


WARC_ROWS = pa.schema([("record_id", pa.string()), ("page_id", pa.string()),
                       ("url", pa.string()), ("date", pa.string()), ("type", pa.string()),
                       ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                       ("refers_to", pa.string())])


def warc_row(head: bytes, block: bytes) -> dict | None:
    kind = header_value(head, b"WARC-Type")
    if kind not in ("response", "revisit", "resource"):
        return None
    digest = (header_value(head, b"WARC-Payload-Digest") or "").removeprefix("sha1:")
    page, size, payload = None, len(block), block
    if kind != "resource":
        split = re.search(rb"\r?\n\r?\n", block)
        http, payload = (block[:split.end()], block[split.end():]) if split else (block, b"")
        page = header_value(http, b"X-Page-Id")
        size = len(payload)
    if kind == "revisit":
        size = int(header_value(http, b"Content-Length") or 0)
    elif sha1(payload) != digest:
        raise ArchiveError(f"payload does not have its digest {digest}")
    uri = lambda name: (header_value(head, name) or "").strip("<>") or None
    return {"record_id": uri(b"WARC-Record-ID"), "page_id": page,
            "url": header_value(head, b"WARC-Target-URI"),
            "date": header_value(head, b"WARC-Date"), "type": kind, "payload_bytes": size,
            "payload_digest": digest, "refers_to": uri(b"WARC-Refers-To")}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses, revisits and resources of all WARC archives of a folder.

    record_id, page_id (text), url, date, type, payload_bytes, payload_digest, refers_to (a
    record id). Digests of payloads are checked; a revisit has the size and digest of the
    payload it leaves out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [warc_row(*r) for r in warc_records(unpacked(content.as_py()))]
                rows = [r for r in rows if r]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, WARC_ROWS)

    return _files(spark, path).mapInArrow(
        run, "record_id string, page_id string, url string, date string, type string, "
             "payload_bytes long, payload_digest string, refers_to string")
