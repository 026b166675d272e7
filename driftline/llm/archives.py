"""Legacy web archives (ARC) to WARC: writing, parsing and conversion.

An ARC file begins with a version block whose first body line tells the version; the version tells which fields a
record's header line has. Fields are read from the right, so a url may hold spaces. A record's body has the declared
length, whatever it holds. Conversion synthesises what ARC lacks: record ids, timestamps in ISO form, record types and
digests.

Record ids are UUIDs of version 8 that hold the row's id, so a revisit record names the id of its response. Null urls
become "-"; null html is an empty payload. Rows with equal ids and payloads are alike: all response, or all revisit.
Rows without an id are written, as responses; their records read back without an id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_grouped, map_slices, scratch, stored

#: Header fields of ARC records by version. Fixed values.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of a file, about: it has as many records as such payloads have on average, so that it fits a task's memory.
FILE_BYTES = 32 << 20
#: About what a record takes besides its payload.
RECORD_BYTES = 600


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_line(version: int, values: dict[str, str]) -> bytes:
    clean = {k: "".join("%%%02X" % ord(c) if c in "\r\n" or (c == " " and k != "URL") else c for c in v) for k, v in values.items()}
    return (" ".join(clean.get(f) or "-" for f in ARC_FIELDS[version]) + "\n").encode()


def write_arc(records: list[tuple[str, bytes]], version: int, date: str = "20200101000000") -> bytes:
    """An archive of (url, body) records."""
    about = f"{version} 0 driftline\n{' '.join(ARC_FIELDS[version])}\n".encode()
    out = [arc_line(version, {"URL": "filedesc://pages.arc", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Offset": "0", "Archive-length": str(len(about))}), about, b"\n"]
    for url, body in records:
        out += [arc_line(version, {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Offset": str(sum(map(len, out[-3:]))), "Archive-length": str(len(body))}), body, b"\n"]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record after the version block."""
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line doesn't end")
        line = data[at:end].decode()
        if not line:
            at = end + 1
            continue
        fields = ARC_FIELDS[1 if at == 0 and line.count(" ") < len(ARC_FIELDS[2]) - 1 else version if at else 2]
        values = dict(zip(fields, line.rsplit(" ", len(fields) - 1), strict=True))
        size = int(values["Archive-length"])
        body = data[end + 1 : end + 1 + size]
        if len(body) < size:
            raise ValueError("an ARC record is shorter than its declared length")
        at_start, at = at, end + 1 + size
        if at_start == 0:
            version = int(body.split(b" ", 1)[0])
        else:
            yield values, body


def record_id(row_id: int | None, url: str) -> str:
    """A UUID of version 8: 64 bits of the row's id, a bit that tells whether there is one, 57 bits of a hash of the id, else of the url."""
    name = url if row_id is None else f"page {row_id}"
    low = int.from_bytes(hashlib.sha1(name.encode()).digest()[:8], "big") >> 7
    n = (row_id or 0) & (2**64 - 1)
    bits = (n >> 16) << 80 | 8 << 76 | ((n >> 4) & 0xFFF) << 64 | 2 << 62 | (n & 15) << 58 | (row_id is not None) << 57 | low
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def row_id(record: str) -> int | None:
    """The row's id in a record id."""
    bits = uuid.UUID(record.strip("<>")[9:]).int
    if not bits >> 57 & 1:
        return None
    n = (bits >> 80) << 16 | ((bits >> 64) & 0xFFF) << 4 | (bits >> 58) & 15
    return n - 2**64 if n >= 2**63 else n


def to_warc(values: dict[str, str], body: bytes, own: str, response: str | None) -> str:
    """The WARC record, without the blank lines at its end, of an ARC record; response: the record id that a revisit refers to."""
    head, found, payload = body.partition(b"\r\n\r\n")
    block = (head + found if response else body).decode()
    date = datetime.strptime(values["Archive-date"][:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if response else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", f"WARC-Target-URI: {values['URL']}", f"WARC-IP-Address: {values['IP-address']}"]
    lines += [f"WARC-Refers-To: {response}", f"WARC-Profile: {REVISIT_PROFILE}"] if response else [f"WARC-Block-Digest: sha1:{base32_sha1(body)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block


def read_warc(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; blocks have the declared lengths."""
    while line := file.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := file.readline().decode().rstrip("\r\n")):
            name, _, value = line.partition(":")
            fields[name.strip()] = value.strip()
        block = file.read(size := int(fields["Content-Length"]))
        if len(block) < size:
            raise ValueError("a WARC record is shorter than its declared length")
        yield fields, block


def http_body(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def find_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """id, sha1 (hex), refers_to of the rows whose payload (html) a row with a larger id has."""
    rows = stored(pages.select("id", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").alias("bytes")))
    groups = rows.filter((F.col("bytes") >= least_bytes) & F.col("id").isNotNull()).groupBy("sha1").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    joined = join_grouped(rows.filter(F.col("bytes") >= least_bytes), stored(groups), "sha1", "size", rows.count())
    return joined.filter("id < refers_to").select("id", "sha1", "refers_to").distinct()


def write_archives(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Writes pages as ARC archives, converts these, and writes the WARC archives to the returned folder in shared storage."""
    pages = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(url_col, F.lit("-")).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    revisits = stored(find_revisits(pages, least_bytes))
    both = pages.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).join(revisits, ["id", "sha1"], "left").select("id", "url", "html", "refers_to")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, urls, htmls, refers = (c.to_pylist() for c in batch.columns)
        version = 1 + (ids[0] or 0) % 2
        archive = write_arc([(url, http_body(html.encode())) for url, html in zip(urls, htmls, strict=True)], version)
        out = []
        for n, to, (values, body) in zip(ids, refers, read_arc(archive), strict=True):
            out.append(to_warc(values, body, record_id(n, values["URL"]), None if to is None else record_id(to, "")))
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    path, (n, size) = scratch(pages.sparkSession), pages.agg(F.count(F.lit(1)), F.sum(F.octet_length("html"))).first()
    records = max(1, FILE_BYTES * n // max(size or 0, n * RECORD_BYTES, 1))
    map_slices(both, work, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
    return path


def read_archives(spark, path: str) -> DataFrame:
    """page id, payload_bytes, payload_digest, record_type, refers_to of every record; a response's are of its payload as read."""

    def parse(content: bytes) -> Iterator[tuple]:
        for fields, block in read_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
            head, _, payload = block.partition(b"\r\n\r\n")
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response":
                if (read := base32_sha1(payload)) != digest:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
                size, digest, to = len(payload), read, None
            else:
                size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                to = row_id(fields["WARC-Refers-To"])
            yield row_id(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], to

    names, kinds = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(zip(*parse(content.as_py()), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
