"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A derived record names its response in WARC-Refers-To, keeps the target URI and date, and has a digest of its own block.
The metadata record's block (application/warc-fields) holds the source's id, HTTP status, HTTP headers and payload
digest; the conversion record's block is the page's visible text in UTF-8, with the source's digest in its headers.
Record ids are name-based UUIDs of the response's id, its payload's digest and the record type, so a retried task makes the
same records, and responses that share an id but not their payload get records of their own.

Null payloads count as empty, null URIs give records without a target; rows that repeat id and payload give repeated
records with one id. Control characters in a URI or a header's value are percent-encoded, so no value makes a header line.
``record_bytes`` serialises a record, ``parse_records`` reads records back from bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.htmltext import visible_text

VERSION = "WARC/1.1"
NAMESPACE = uuid.NAMESPACE_URL
#: Headers of the source's HTTP response that the metadata record repeats.
SOURCE_HEADERS = ("content-type", "content-language", "last-modified", "etag", "content-encoding")
RESPONSE = "record_id string, target_uri string, date string, status int, http_headers string, payload string"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def derived_id(source: str, kind: str, payload: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {payload} {source}')}>"


def header_value(text: str) -> str:
    """The text as a header's value: one line, control characters percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages that come without HTTP headers: status 200 and headers made from the page.
    Ids are made from key, URL and a digest of the page. ``key`` is kept."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    name = F.md5(F.concat_ws("\n", known(F.col(key).cast("string")), known(F.col(url)), F.md5(F.coalesce(F.col(html), F.lit("")))))
    part = lambda a, n: F.substring(name, a, n)
    record_id = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))
    size = F.octet_length(F.coalesce(F.col(html), F.lit(""))).cast("string")
    headers = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), size)
    return pages.select(F.col(key), record_id.alias("record_id"), F.col(url).alias("target_uri"), F.lit(date).alias("date"), F.lit(200).alias("status"), headers.alias("http_headers"), F.col(html).alias("payload"))


def parse_http(headers: str | None) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in (headers or "").splitlines()) if v}


def derive(record_id: str | None, target: str | None, date: str | None, status: int | None, http_headers: str | None, payload: str | None) -> list[tuple[str, dict[str, str], bytes]]:
    """(record id, headers in order, block) of the metadata and of the conversion record of one response. A response without an
    id is given one by its payload, target and date, so that its two records still refer to the same."""
    body = (payload or "").encode("utf-8", "replace")
    source, sent = digest(body), parse_http(http_headers)
    record_id = header_value(record_id) if record_id else derived_id(f"{target} {date}", "response", source)
    fields = [("source-record-id", record_id), ("http-status", "" if status is None else str(status)), *((f"http-{k}", header_value(sent[k])) for k in SOURCE_HEADERS if k in sent), ("payload-digest", source), ("payload-length", str(len(body)))]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    text = visible_text(payload).encode("utf-8", "replace")
    out = []
    for kind, mime, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        own = derived_id(record_id, kind, source)
        headers = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Refers-To": record_id}
        headers |= {"WARC-Target-URI": header_value(target)} if target is not None else {}
        headers |= {"WARC-Date": header_value(date)} if date is not None else {}
        headers |= {"X-Source-Payload-Digest": source, "Content-Type": mime, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
        out.append((own, headers, block))
    return out


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each whole record; of data that is cut off in a record, those before it."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if end + 4 + size > len(data):
            return
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def derivatives(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows a response: key, warc_type, record_id, refers_to, target_uri, block_digest, source_digest, content_type,
    content_length and record (the serialised record)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = ("warc_type", "record_id", "refers_to", "target_uri", "block_digest", "source_digest", "content_type")
    out = T.StructType([records.schema[key], *(T.StructField(c, T.StringType()) for c in names), T.StructField("content_length", T.LongType()), T.StructField("record", T.BinaryType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for own, h, block in derive(*row[1:]):
                    rows.append((row[0], h["WARC-Type"], own, row[1] or h["WARC-Refers-To"], row[2], h["WARC-Block-Digest"], h["X-Source-Payload-Digest"], h["Content-Type"], len(block), record_bytes(h, block)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return records.select(key, "record_id", "target_uri", "date", "status", "http_headers", "payload").mapInArrow(run, out)
