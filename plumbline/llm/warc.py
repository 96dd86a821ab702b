"""Legacy archive converter: ARC records (version 1 and 2 headers) to WARC records, and both ways of reading.

An ARC file is a version block (``filedesc://``) and URL records, each one header line whose fields
depend on the version, and as many bytes as the line's last field declares. The converter follows
the declared lengths, and synthesises what WARC has and ARC hasn't: record ids, ISO timestamps,
record types and SHA-1 digests of block and payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, new_path

FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
SEPARATOR = "\r\n\r\n"
#: Archive files get about so many bytes of payload.
FILE_BYTES = 16 << 20
#: A table of repeated payloads is broadcast only when it has been counted to have no more rows.
BROADCAST_ROWS = 200_000


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes
    fields: dict[str, str] = field(default_factory=dict)

    def payload(self) -> bytes:
        """The block behind the HTTP head, where the record has one."""
        if self.headers.get("Content-Type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block

    def serialised(self) -> bytes:
        """The record without the two line ends that close it."""
        head = "".join(f"{k}: {v}\r\n" for k, v in ({"WARC-Type": self.kind} | self.headers | {"Content-Length": str(len(self.block))}).items())
        return f"WARC/1.1\r\n{head}\r\n".encode() + self.block


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of every record, by declared length; the version block sets the fields."""
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        if not line:  # records are parted by a line end
            at = (end if end >= 0 else len(data)) + 1
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        if line.startswith(b"filedesc://"):
            length = int(parts[-1])
            content = data[end + 1 : end + 1 + length]
            version = int(content.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            names = FIELDS[version if len(parts) == len(FIELDS[version]) else 1]
        else:
            names = FIELDS[version]
        if len(parts) != len(names):
            raise ValueError(f"an ARC version {version} header has {len(names)} fields, not {len(parts)}: {line[:200]!r}")
        fields = dict(zip(names, parts, strict=True))
        length = int(fields["length"])
        content = data[end + 1 : end + 1 + length]
        if len(content) != length:
            raise ValueError(f"the record of {fields['url']} ends after {len(content)} of {length} bytes")
        yield fields, content
        at = end + 1 + length


def arc_record(fields: dict[str, str], content: bytes, version: int) -> bytes:
    return (" ".join([*(fields.get(k) or "-" for k in FIELDS[version][:-1]), str(len(content))]) + "\n").encode() + content + b"\n"


def version_block(version: int, name: str = "part.arc", date: str = "20240101000000") -> bytes:
    body = f"{version} 0 converter\n{' '.join({'url': 'URL', 'ip': 'IP-address', 'date': 'Archive-date', 'mime': 'Content-type', 'status': 'Result-code', 'checksum': 'Checksum', 'location': 'Location', 'offset': 'Offset', 'filename': 'Filename', 'length': 'Archive-length'}[k] for k in FIELDS[version])}\n".encode()
    return arc_record({"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "mime": "text/plain", "status": "200"}, body, version)


def timestamp(date: str) -> str:
    """The ISO form of an ARC date of 8 to 14 digits; missing digits are the earliest."""
    digits = re.sub(r"\D", "", date)[:14]
    digits += "00010101000000"[len(digits) :]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def convert(fields: dict[str, str], content: bytes, key: str = "") -> Record:
    """One ARC record as WARC: ``warcinfo`` for the version block, ``response`` for HTTP, else ``resource``."""
    url, date = fields["url"], timestamp(fields["date"])
    if url.startswith("filedesc://"):
        kind, mime = "warcinfo", "application/warc-fields"
        content = b"software: converter\r\nformat: WARC File Format 1.1\r\n"
    elif content.startswith(b"HTTP/"):
        kind, mime = "response", "application/http;msgtype=response"
    else:
        kind, mime = "resource", fields["mime"]
    headers = {"WARC-Record-ID": record_id("page", key) if key else record_id(url, date), "WARC-Date": date, "Content-Type": mime}
    if kind == "warcinfo":
        return Record(kind, headers | {"WARC-Filename": url.removeprefix("filedesc://")}, content, fields)
    headers["WARC-Target-URI"] = url
    if re.fullmatch(r"[0-9.]+|[0-9a-fA-F:]+", fields["ip"]):
        headers["WARC-IP-Address"] = fields["ip"]
    record = Record(kind, headers, content, fields)
    headers["WARC-Payload-Digest"] = "sha1:" + base32_sha1(record.payload())
    headers["WARC-Block-Digest"] = "sha1:" + base32_sha1(content)
    return record


def as_revisit(record: Record, refers_to: str, refers_url: str | None = None) -> Record:
    """The record without its payload, pointing to the one that has an identical payload."""
    head = record.block[: len(record.block) - len(record.payload())]
    headers = dict(record.headers)
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": refers_to, "WARC-Block-Digest": "sha1:" + base32_sha1(head)}
    if refers_url:
        headers["WARC-Refers-To-Target-URI"] = refers_url
    return Record("revisit", headers, head)


def parse_warc(data: bytes) -> Iterator[Record]:
    """The records of an uncompressed WARC file, by declared length."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {first[:80]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        length = int(headers.pop("Content-Length"))
        yield Record(headers.pop("WARC-Type"), headers, data[end + 4 : end + 4 + length])
        at = end + 4 + length


def http_head(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()


def repeated_payloads(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``sha, n, first``: payloads of at least ``least_bytes`` that several pages have, and the smallest page id of them."""
    sized = pages.select("page_id", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    return sized.where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """``page_id, url, html`` to compressed WARC files below ``path``.

    Each page is made an ARC record (version 1 or 2 by turns) that the converter reads. Spark's text
    writer writes the files, with the two line ends of a record as its separator, so they land
    wherever Spark can write and a lost executor's files are committed once.
    """
    repeated = cut(repeated_payloads(pages, least_bytes), "repeated")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha"), F.octet_length(html).alias("n"))
    few = repeated.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(repeated) if few else repeated, ["sha", "n"], "left").select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, html, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                payload = html.as_py().encode("utf-8", "surrogatepass")
                version = 1 + (page or 0) % 2
                fields = {"url": re.sub(r"\s", "%20", url or "urn:none"), "ip": "192.0.2.1", "date": "20240101000000", "mime": "text/html", "status": "200"}
                arc = version_block(version) + arc_record(fields, http_head(payload) + payload, version)
                _, (fields, content) = parse_arc(arc)
                record = convert(fields, content, str(page))
                if first is not None:
                    record = as_revisit(record, record_id("page", str(first)))
                    record.headers["X-Refers-To-Page"] = str(first)
                if page is not None:
                    record.headers["X-Page-Id"] = str(page)
                record.headers["X-Page-Url"] = base64.b64encode((url or "").encode()).decode()
                out.append(record.serialised().decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    size = pages.agg(F.avg(F.octet_length("html")), F.max(F.octet_length("html"))).first()
    each = int(max(1, min(50_000, FILE_BYTES / max(1, size[0] or 1), 16 * FILE_BYTES / max(1, size[1] or 1))))
    rows.mapInArrow(records, "value string").write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok`` of every record below ``path``.

    Size and digest of a revisit's payload, which it doesn't hold, are those that its HTTP head and header declare.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in parse_warc(gzip.decompress(content.as_buffer())):
                    declared = r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    page, first = r.headers.get("X-Page-Id"), r.headers.get("X-Refers-To-Page")
                    if r.kind == "revisit":
                        n, digest, ok = int(re.search(rb"Content-Length: (\d+)\r\n", r.block)[1]), declared, True
                    else:
                        payload = r.payload()
                        n, digest = len(payload), base32_sha1(payload)
                        ok = digest == declared
                    rows.append((None if page is None else int(page), n, digest, r.kind, None if first is None else int(first), ok))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"])

    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean")


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages as WARC files in the shared folder and reads those back, one row for each page.

    A null html is an empty payload; a null url is recorded as ``urn:none``; rows that repeat the
    smallest page id of a payload are all responses; extra columns are ignored.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
