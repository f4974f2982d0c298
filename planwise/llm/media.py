"""Media columns: interleaved sequences of text and media references, payloads found by digest.

A page becomes an array of items in reading order: text blocks, and references with the digest of
their payload and a caption. References and payloads meet in a join on the digest, so equal
payloads are stored and read once; an item's position travels with it, and with its caption.

A null page has no items, an empty one neither. A reference whose digest the store lacks keeps its
row, with null payload columns. Rows that repeat are kept as often as they come; a digest stored
more than once counts once. Other columns of the inputs play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markup import BLOCKS, attributes, parts, tidy
from .shared import column_function

ITEM = "struct<pos:int,kind:string,text:string,digest:string,caption:string>"
ITEM_ARROW = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
DIGEST_SCHEME = "sha256:"
#: Payloads are padded to whole rows of so many samples.
ROW = 576


def items(html: str | None) -> list[dict]:
    """Items in order. A figure's caption goes to its images since the caption before; an image without one takes its alt text."""
    out: list[dict] = []
    line: list[str] = []
    caption: list[str] | None = None
    waiting: list[dict] = []

    def flush() -> None:
        if text := tidy(line):
            out.append({"pos": len(out), "kind": "text", "text": text, "digest": None, "caption": None})
        line.clear()

    for kind, name, content in parts(html or ""):
        if kind == "text":
            (line if caption is None else caption).append(content)
        elif name == "figcaption":
            if kind == "open":
                flush()
                caption = []
            elif caption is not None:
                for item in waiting:
                    item["caption"] = tidy(caption) or item["caption"]
                caption, waiting = None, []
        elif name in ("img", "video", "audio", "source") and kind == "open":
            flush()
            given = attributes(content)
            if (src := given.get("src", "")).startswith(DIGEST_SCHEME):
                out.append({"pos": len(out), "kind": "media", "text": None, "digest": src[len(DIGEST_SCHEME) :], "caption": given.get("alt") or None})
                waiting.append(out[-1])
        elif name in BLOCKS and caption is None:
            flush()
            if name == "figure":
                waiting = []
    if caption:
        line.extend(caption)
    flush()
    return out


@column_function(f"array<{ITEM}>")
def interleaved(html: pa.Array) -> pa.Array:
    return pa.array([items(x.as_py()) for x in html], pa.list_(ITEM_ARROW))


def payload_of(text: str | None) -> bytes:
    """UTF-8, filled with bytes 255 to whole rows, one row at least."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % ROW or ROW * (not raw))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes) -> bytes:
    """An 8-bit grey PNG, one sample a byte, ROW samples a line."""
    lines = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(lines), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def samples(stored: bytes) -> np.ndarray:
    """The samples of such a PNG, by line; checksums are verified."""
    if stored[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG signature")
    at, data, shape = 8, [], (0, 0)
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)[::-1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:]


def feature(grey: np.ndarray) -> str:
    """Size, mean, and a 16-bin histogram, in thousandths of the samples."""
    counts = np.bincount(grey.reshape(-1) >> 4, minlength=16)
    share = counts * 1000 // grey.size
    return f"{grey.shape[1]}x{grey.shape[0]};mean={int(grey.sum(dtype=np.int64)) * 1000 // grey.size};hist={','.join(map(str, share.tolist()))}"


STORED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@column_function("digest string, media binary")
def stored_media(texts: pa.Array) -> pa.Array:
    digests, media = [], []
    for x in texts:
        payload = payload_of(x.as_py())
        digests.append(hashlib.sha256(payload).hexdigest())
        media.append(png(payload))
    return pa.StructArray.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])


@column_function(STORED)
def read_back(media: pa.Array) -> pa.Array:
    rows = []
    for x in media:
        raw = x.as_py()
        grey = samples(raw)
        payload = grey.tobytes()
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(grey)))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in STORED.split(", ")])


@column_function("html string, n_bytes long")
def page_of(texts: pa.Array) -> pa.Array:
    """A page that shows a text's payload as its one figure."""
    html, sizes = [], []
    for x in texts:
        text = x.as_py()
        payload = payload_of(text)
        n = len((text or "").encode("utf-8", "surrogatepass"))
        html.append(f'<article><h1>Text</h1><figure><img src="{DIGEST_SCHEME}{hashlib.sha256(payload).hexdigest()}"><figcaption>{escape(f"{n} bytes in {len(payload) // ROW} rows")}</figcaption></figure></article>')
        sizes.append(n)
    return pa.StructArray.from_arrays([pa.array(html, pa.string()), pa.array(sizes, pa.int64())], names=["html", "n_bytes"])


def media_store(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, media), each digest once; equal ones already meet before the shuffle."""
    made = docs.select(stored_media(F.col(text)).alias("_m")).select("_m.digest", "_m.media")
    return made.groupBy("digest").agg(F.first("media").alias("media"))


def interleave(pages: DataFrame, keys: list[str], html: str | Column) -> DataFrame:
    """One row an item: keys, pos, kind, text, digest, caption."""
    return pages.select(*keys, F.explode(interleaved(F.col(html) if isinstance(html, str) else html)).alias("_i")).select(*keys, "_i.*")


def resolve(sequence: DataFrame, store: DataFrame) -> DataFrame:
    """Joins what the store has for a digest to the items that refer to it; positions and captions stay with their item.

    Items without a digest get no partner and no shuffle key of their own: they are joined on their position's hash.
    """
    known = store.withColumnRenamed("digest", "_digest")
    key = F.coalesce(F.col("digest"), F.concat(F.lit("text-"), F.pmod(F.xxhash64("pos", "text"), F.lit(4096)).cast("string")))
    return sequence.join(known, key == F.col("_digest"), "left").drop("_digest")


def sequences(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """One row a page again: keys and items, an array ordered by position."""
    columns = [c for c in resolved.columns if c not in (*keys, "pos")]
    return resolved.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("items"))
