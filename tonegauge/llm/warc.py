"""Derivatives of web archive responses: linked metadata and plain-text conversion records.

Every response record (bytes: archive header, HTTP header, body) gives

* a `metadata` record: JSON with the envelope (archive and HTTP headers of the source, both digests), the
  title and the links of the page;
* a `conversion` record: the visible text of the page.

Both carry `WARC-Refers-To` with the response's record id, its target URI and date, and digests of their
own block; their ids follow from the response's id, so a rerun writes the same records. Records are
computed one by one where the response lies: no shuffle, and memory is one Arrow batch.

`responses` builds response records from a table of pages, `parse` reads a record, `write` stores records
as compressed archive files, one member per record, `read` reads such files.

Edge cases: a null or empty html is a response with an empty body; a null url gives the URI `urn:none`; a
record that is no response or is broken gives no derivative; repeated pages give equal records; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.llm.common import small_batches

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs of RFC 4122
DATE = "2024-01-01T00:00:00Z"
HIDDEN = re.compile(r"<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|main|blockquote|pre|title|body|head|hr|dd|dt|dl|form|figure|aside)\b[^>]*>", re.I)
TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
LINK = re.compile(r"<(a|link|img|script|iframe|area)\b([^>]*)>", re.I)
TARGET = re.compile(r"""\b(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

RECORD = "record_id string, type string, refers_to string, target_uri string, record binary"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of one record; None if it is broken."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        return None
    headers = _fields(head.split(b"\r\n")[1:])
    try:
        length = int(headers["Content-Length"])
    except (KeyError, ValueError):
        return None
    return (headers, rest[:length]) if 0 <= length <= len(rest) else None


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines if b":" in line)
    return {k.strip(): v.strip() for k, _, v in pairs}


def visible_text(page: str) -> str:
    """Lines of visible text: hidden elements out, block tags as line ends, entities resolved."""
    text = TAG.sub(" ", BREAK.sub("\n", HIDDEN.sub(" ", page)))
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def links(page: str) -> list[dict[str, str]]:
    out = []
    for m in LINK.finditer(page):
        for t in TARGET.finditer(m.group(2)):
            url = next(x for x in t.groups()[1:] if x is not None)
            out.append({"path": f"{m.group(1).upper()}@/{t.group(1).lower()}", "url": html.unescape(url)})
    return out


def response_record(uri: str | None, page: str | None, key: str) -> tuple[str, bytes]:
    """Record id and bytes of the response that a page stands for."""
    uri = " ".join((uri or "urn:none").split())
    body = (page or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    record_id = f"<urn:uuid:{uuid.uuid5(SPACE, f'{key} {uri}')}>"
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", digest(body)),
        ("WARC-Block-Digest", digest(http + body)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record_id, record(headers, http + body)


def derivatives_of(data: bytes) -> list[tuple[str, str, str, str, bytes]]:
    """The metadata and the conversion record of one response record."""
    parsed = parse(data)
    if parsed is None or parsed[0].get("WARC-Type") != "response" or "WARC-Record-ID" not in parsed[0]:
        return []
    source, block = parsed
    head, _, body = block.partition(b"\r\n\r\n")
    status, *fields = head.split(b"\r\n")
    page = body.decode("utf-8", "replace")
    title = TITLE.search(page)
    described = {
        "Envelope": {
            "WARC-Header-Metadata": source,
            "Actual-Content-Length": len(block),
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": status.decode("latin-1"),
                    "Headers": _fields(fields),
                    "Entity-Length": len(body),
                    "Entity-Digest": digest(body),
                    "HTML-Metadata": {
                        "Title": " ".join(html.unescape(title.group(1)).split()) if title else None,
                        "Links": links(page),
                    },
                }
            },
        }
    }
    blocks = {
        "metadata": ("application/json", json.dumps(described, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")),
        "conversion": ("text/plain; charset=utf-8", visible_text(page).encode("utf-8", "surrogatepass")),
    }
    out = []
    for kind, (media, content) in blocks.items():
        record_id = f"<urn:uuid:{uuid.uuid5(SPACE, kind + ' ' + source['WARC-Record-ID'])}>"
        headers = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", record_id),
            ("WARC-Refers-To", source["WARC-Record-ID"]),
            ("WARC-Refers-To-Payload-Digest", source.get("WARC-Payload-Digest", digest(body))),
            ("WARC-Date", source.get("WARC-Date", DATE)),
            ("WARC-Target-URI", source.get("WARC-Target-URI", "urn:none")),
            ("WARC-Block-Digest", digest(content)),
            ("Content-Type", media),
        ]
        out.append((record_id, kind, source["WARC-Record-ID"], source.get("WARC-Target-URI", "urn:none"), record(headers, content)))
    return out


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table (page_id, url, html)."""
    small_batches(pages.sparkSession)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*response_record(u, h, str(k)), u) for k, u, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")))]
            yield _records([(r, "response", None, u, data) for r, data, u in rows])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(built, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records in the binary column `record`."""
    small_batches(records.sparkSession)

    def derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _records([row for data in batch.column("record").to_pylist() if data for row in derivatives_of(data)])

    return records.select("record").mapInArrow(derived, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["record_id", "type", "refers_to", "target_uri", "record"])


def write(records: DataFrame, path: str) -> None:
    """Compressed archive files: one gzip member per record, joined per partition in order of record id.

    Members travel as rows of a text-free binary table; `path` is any folder that Spark can write.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for data in batch.column("record").to_pylist():
                c = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed.append(c.compress(data) + c.flush())
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(packed, pa.binary())], ["record_id", "member"])

    records.select("record_id", "record").sortWithinPartitions("record_id").mapInArrow(members, "record_id string, member binary").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """record_id and record of what `write` stored."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [zlib.decompress(m, 31) for m in batch.column("member").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(data, pa.binary())], ["record_id", "record"])

    return spark.read.parquet(path).mapInArrow(unpacked, "record_id string, record binary")


def derived_records(pages: DataFrame) -> DataFrame:
    """Every derivative of every page: ids, links between records, digests, lengths and texts."""
    small_batches(pages.sparkSession)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, u, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                _, response = response_record(u, h, str(k))
                for record_id, kind, refers_to, uri, data in derivatives_of(response):
                    headers, block = parse(data)
                    out.append((k, kind, record_id, refers_to, uri, headers["WARC-Refers-To-Payload-Digest"], headers["WARC-Block-Digest"], len(block), block.decode("utf-8", "replace")))
            columns = list(zip(*out)) if out else [[]] * 9
            kinds = (batch.schema.field("page_id").type, *[pa.string()] * 6, pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], NAMES)

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(built, f"page_id {kind}, type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, length long, content string")


NAMES = ["page_id", "type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "length", "content"]
