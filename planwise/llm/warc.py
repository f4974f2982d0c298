"""WARC derivatives: of each response record one metadata and one conversion record.

The metadata record (application/warc-fields) holds what the page says of itself; the conversion
record holds its plain text. Both name the response in WARC-Refers-To, and carry its target URI,
its date, its HTTP content type and its digests, so they can be traced and checked without it.
Record ids follow from the content, so a task that runs twice writes the same records.

A null page is an empty payload and gives an empty text; a null address is written as an empty URI.
Rows that repeat give equal records. Records that are no responses are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import attributes, blocks, parts, tidy
from .shared import column_function

VERSION = "WARC/1.1"
#: Record ids are made in this name space.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def one_line(value: str) -> str:
    return " ".join(value.split())


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {one_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


def response(url: str | None, html: str | None, date: str) -> bytes:
    payload = (html or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    target = one_line(url or "")
    return write_record(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'response {target} {digest(block)}')}>"), ("WARC-Date", date), ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


def page_fields(html: str) -> list[tuple[str, str]]:
    """Title, language, character set, description and outgoing links, in order of appearance."""
    title: list[str] = []
    found: list[tuple[str, str]] = []
    inside = False
    for kind, name, content in parts(html):
        if kind == "text":
            if inside:
                title.append(content)
        elif name == "title":
            if inside and kind == "close" and not any(k == "title" for k, _ in found):
                found.append(("title", tidy(title)))
            inside = kind == "open"
        elif kind == "open" and "=" in content:
            given = attributes(content)
            if name == "html" and given.get("lang"):
                found.append(("language", given["lang"]))
            elif name == "meta" and given.get("charset"):
                found.append(("charset", given["charset"]))
            elif name == "meta" and given.get("name", "").lower() == "description":
                found.append(("description", given.get("content", "")))
            elif name == "a" and given.get("href"):
                found.append(("outlink", given["href"]))
    return found


def derive(record: bytes) -> list[tuple[str, str, str, bytes]]:
    """(type, record id, refers to, record) of the two derivatives of a response; none of another record."""
    headers, block = read_record(record)
    if headers.get("warc-type") != "response":
        return []
    http, _, payload = block.partition(b"\r\n\r\n")
    html = payload.decode("utf-8", "replace")
    source = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    linked = [("WARC-Date", headers["warc-date"]), ("WARC-Target-URI", headers["warc-target-uri"]), ("WARC-Refers-To", headers["warc-record-id"]), ("WARC-Refers-To-Target-URI", headers["warc-target-uri"]), ("WARC-Refers-To-Date", headers["warc-date"])]
    fields = [
        ("source-content-type", source.get("content-type", "")), ("source-payload-digest", headers["warc-payload-digest"]), ("source-block-digest", headers["warc-block-digest"]),
        *((f"source-{k}", v) for k, v in source.items() if k and k != "content-type"), *page_fields(html),
    ]
    bodies = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields)),
        "conversion": ("text/plain; charset=utf-8", "\n".join(blocks(html))),
    }
    out = []
    for kind, (content_type, body) in bodies.items():
        data = body.encode("utf-8", "replace")
        own = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {headers["warc-record-id"]}')}>"
        head = [("WARC-Type", kind), ("WARC-Record-ID", own), *linked, ("WARC-Source-Payload-Digest", headers["warc-payload-digest"]), ("WARC-Source-Content-Type", source.get("content-type", "")), ("WARC-Block-Digest", digest(data)), ("Content-Type", content_type)]
        out.append((kind, own, headers["warc-record-id"], write_record(head, data)))
    return out


RECORD = pa.struct([("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("record", pa.binary())])


def responses(date: str):
    """A column function: address and page to a response record."""

    @F.arrow_udf("binary")
    def record(urls: pa.Array, pages: pa.Array) -> pa.Array:
        return pa.array([response(u.as_py(), p.as_py(), date) for u, p in zip(urls, pages)], pa.binary())

    return record


@column_function("array<struct<record_type:string,record_id:string,refers_to:string,record:binary>>")
def derivatives(records: pa.Array) -> pa.Array:
    return pa.array([None if x.as_py() is None else [dict(zip(("record_type", "record_id", "refers_to", "record"), d)) for d in derive(x.as_py())] for x in records], pa.list_(RECORD))


@column_function("target_uri string, source_content_type string, source_payload_digest string, block_digest string, n_bytes long, body string")
def record_fields(records: pa.Array) -> pa.Array:
    """Reads derivative records back."""
    rows = []
    for x in records:
        h, block = read_record(x.as_py())
        rows.append((h["warc-target-uri"], h["warc-source-content-type"], h["warc-source-payload-digest"], h["warc-block-digest"], len(block), block.decode("utf-8")))
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["target_uri", "source_content_type", "source_payload_digest", "block_digest", "n_bytes", "body"])


def derive_records(records: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """keys, record_type, record_id, refers_to, record: two rows a response; no shuffle."""
    return records.select(*keys, F.explode(derivatives(F.col(record))).alias("_d")).select(*keys, "_d.*")
