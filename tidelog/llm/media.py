"""Interleaved document sequences: ordered text and media references from HTML, media resolved by digest."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import fresh_path, materialize

#: Bytes in a row of samples: 64 pixels of three 8-bit samples. A payload is a whole number of rows.
ROW = 192
SCHEME = "media:sha256:"

# Fixed values of the PNG format.
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
BLOCK_TAGS = {"p", "div", "article", "section", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "blockquote", "pre", "br", "hr", "body", "html"}
SILENT_TAGS = {"script", "style", "template", "noscript", "head"}
MEDIA_TAGS = {"img": "image", "video": "video", "audio": "audio"}


class _Sequencer(HTMLParser):
    """Collects (kind, text, reference, caption) in page order. A figure's caption belongs to the media in that figure."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list[str | None]] = []
        self.text: list[str] = []
        self.silent = 0
        self.figure: list[list[str | None]] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.items.append(["text", text, None, None])
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT_TAGS:
            self.silent += 1
        if tag in BLOCK_TAGS and self.caption is None:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA_TAGS and not self.silent:
            self.flush()
            own = dict(attrs)
            item = [MEDIA_TAGS[tag], None, own.get("src"), " ".join((own.get("alt") or "").split()) or None]
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.figure or []:
                item[3] = caption or item[3]
            if not self.figure and caption:
                self.items.append(["text", caption, None, None])
        elif tag in BLOCK_TAGS and self.caption is None:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[tuple]:
    """(position, kind, text, reference, caption) of a page's text blocks and media, in order; empty for null."""
    parser = _Sequencer()
    parser.feed(html or "")
    parser.close()
    if parser.caption:
        parser.handle_endtag("figcaption")
    parser.flush()
    return [(k, *item) for k, item in enumerate(parser.items)]


ITEM = "position int, kind string, text string, reference string, caption string"


def sequences(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of pages but the html, and items: array of (position, kind, text, reference, caption). Map-only; null html gives no items."""
    rest = [c for c in pages.columns if c != html_col]
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)
    item = pa.struct([("position", pa.int32()), *((k, pa.string()) for k in ("kind", "text", "reference", "caption"))])
    names = [f.name for f in item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                items = [[dict(zip(names, x, strict=True)) for x in sequence(h)] for h in part.column(len(rest)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(items, pa.list_(item))], names=[*rest, "items"])

    return pages.select(*rest, F.col(html_col).cast("string")).mapInArrow(run, f"{fields}{', ' if rest else ''}items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>")


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """Adds the columns of media (digest, ...; one row per digest, a written table) to exploded items by the digest in `reference`.

    Every item stays, at its position and with its caption; items without media get nulls. Both sides are shuffled
    directly below the join, so that a digest with very many references is split.
    """
    digest = F.when(F.col("reference").startswith(SCHEME), F.substring("reference", len(SCHEME) + 1, 64))
    return items.withColumn("digest", digest).join(media.hint("merge"), "digest", "left")


def to_png(payload: bytes) -> bytes:
    """Losslessly, as a 64 pixels wide 8-bit RGB image."""
    rows = len(payload) // ROW
    raw = np.zeros((rows, ROW + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))

    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, rows, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The samples of an image that to_png has made."""
    if png[:8] != PNG_MAGIC:
        raise ValueError("not a PNG file")
    at, data, rows = 8, [], 0
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        own = png[at + 8 : at + 8 + size]
        if zlib.crc32(own, zlib.crc32(kind)) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            rows = struct.unpack(">IIBBBBB", own)[1]
        elif kind == b"IDAT":
            data.append(own)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, ROW + 1)
    if raw[:, 0].any():
        raise ValueError("rows are filtered")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Height, mean sample and a 64-bit average hash of the image: an 8 by 8 thumbnail of brightness, each cell against the mean."""
    rows = len(payload) // ROW
    gray = np.frombuffer(payload, np.uint8).reshape(rows, ROW // 3, 3).sum(axis=2, dtype=np.int64)
    top = np.arange(8) * rows // 8
    cells = np.add.reduceat(np.add.reduceat(gray, top, axis=0), np.arange(8) * 8, axis=1)
    cells = cells / np.maximum(1, np.diff(np.r_[top, rows]))[:, None]
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"{rows}:{gray.sum() / len(payload):.4f}:{bits}"


def padded(text: Column) -> Column:
    """The text's bytes and then spaces up to a positive multiple of ROW."""
    size = F.octet_length(text)
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(ROW), F.ceil(size / ROW) * ROW).cast("int") - size)).cast("binary")


def store_media(payloads: DataFrame, path: str) -> None:
    """Writes (digest, media) for each row's binary `payload`, the digest being the payload's SHA-256. Map-only; equal payloads may be stored more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own = batch.column(0).slice(lo, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in own]), pa.array([to_png(p) for p in own], pa.binary())], names=["digest", "media"])

    payloads.select("payload").mapInArrow(run, "digest string, media binary").write.option("compression", "none").parquet(path)


MEDIA_SCHEMA = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(spark, path: str) -> DataFrame:
    """MEDIA_SCHEMA, one row per digest, from the stored bytes. A payload that is not its digest's raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MEDIA_SCHEMA.split(", ")]
        types = [pa.string() if x.endswith("string") else pa.int64() for x in MEDIA_SCHEMA.split(", ")]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for digest, media in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    payload = from_png(media)
                    found = hashlib.sha256(payload).hexdigest()
                    if found != digest:
                        raise ValueError(f"{digest} holds other bytes")
                    rows.append((digest, len(payload), found, zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.schema("digest string, media binary").parquet(path).mapInArrow(run, MEDIA_SCHEMA).dropDuplicates(["digest"])


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def documents_as_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, html: each text as a paragraph and a figure that refers to its bytes as media, captioned with the text's size."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.sha2(padded(F.col("text")), 256), F.lit('"><figcaption>'), size.cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    return own.select("doc_id", size.alias("n_bytes"), F.concat(F.lit("<article><p>"), _escaped(F.col("text")), F.lit("</p>"), figure).alias("html"))


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the media's columns, position and caption: one row per document, its media resolved by digest.

    Null texts are empty. Rows that repeat are returned as often as they occur. Payload bytes are read once on the way in
    and once from the store and are never shuffled: features are made per stored row and brought together by digest.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "media")
    store_media(docs.select(padded(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("payload")), path)
    features = materialize(media_features(spark, path), "features")
    pages = sequences(documents_as_pages(docs))
    items = pages.select("doc_id", "n_bytes", F.explode(F.filter("items", lambda x: x["kind"] != "text")).alias("x")).select("doc_id", "n_bytes", "x.position", "x.reference", "x.caption")
    found = resolve(items, features)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
