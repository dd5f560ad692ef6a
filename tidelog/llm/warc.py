"""WARC archives: writing records in segments, reading them back and putting the segments together again."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import fresh_path, materialize

#: Payloads of at least so many bytes are written once and revisited; a record's block is cut after SEGMENT_BYTES, the
#: body's chunked framing after CHUNK_BYTES; an archive holds at most ARCHIVE_RECORDS records.
SHORTEST_REVISIT, SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_RECORDS = 0, 16_384, 4_096, 20_000
#: What ends a record; Spark's text writer puts it after each.
RECORD_END = "\r\n\r\n"

# Fixed values of the format.
VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
RESPONSE_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: 40 bits at a time are 8 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), HEX_DIGITS, BASE32_DIGITS)


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body of a chunked message; chunk extensions and trailers are skipped. ValueError if the framing is broken or cut."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(framed[at : at + size])
        at += size + 2


def record_id(page_id: int | None, row: int, segment: int) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page/{page_id}/{row}/{segment}')}>"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _field(text: str | None) -> str:
    """A header value on one line."""
    return " ".join((text or "").split())


def _records(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, refers: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations."""
    own = [("WARC-Target-URI", _field(url)), ("WARC-Page-ID", "" if page_id is None else str(page_id))]
    if refers is not None:
        more = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Page-ID", str(refers)), ("WARC-Revisited-Length", str(len(payload)))]
        yield _record("revisit", [("WARC-Record-ID", record_id(page_id, row, 1)), *own, ("WARC-Payload-Digest", f"sha1:{digest}"), *more], REVISIT_HEAD)
        return
    block = RESPONSE_HEAD + chunked(payload)
    first = record_id(page_id, row, 1)
    for at in range(0, len(block), segment_bytes):
        k, part = at // segment_bytes + 1, block[at : at + segment_bytes]
        segment = [("WARC-Segment-Number", str(k))] if len(block) > segment_bytes else []
        if k == 1:
            yield _record("response", [("WARC-Record-ID", first), *own, ("WARC-Payload-Digest", f"sha1:{digest}"), *segment], part)
        else:
            last = [("WARC-Segment-Total-Length", str(len(block)))] if at + segment_bytes >= len(block) else []
            yield _record("continuation", [("WARC-Record-ID", record_id(page_id, row, k)), ("WARC-Segment-Origin-ID", first), ("WARC-Target-URI", _field(url)), *segment, *last], part)


def write_archives(pages: DataFrame, path: str, *, shortest_revisit: int = SHORTEST_REVISIT, segment_bytes: int = SEGMENT_BYTES, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Writes (page_id, url, html) as gzip-compressed WARC files under path.

    Of pages with equal payloads of at least shortest_revisit bytes the one with the largest page_id is written in full
    and the others as revisits of it; a null html is an empty payload. Among rows that repeat with that page_id, or where
    all ids are null, every row is a response. Digests are grouped with a partial aggregate, and the join back to the
    payloads is of two exchanges, so that a payload with very many copies is split. Spark's writer commits whole tasks:
    a lost executor leaves no half archive.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", payload_digest(F.col("payload")))
    groups = own.where(F.octet_length("payload") >= shortest_revisit).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1").select("digest", "first"), "digests")
    joined = own.join(groups.hint("merge"), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for page in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    row += 1
                    out += _records(*page[:1], row, *page[1:], segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = joined.select("page_id", "url", "payload", "digest", refers.alias("first")).mapInArrow(render, "value binary")
    records.select(F.col("value").cast("string")).write.options(lineSep=RECORD_END, compression="gzip", maxRecordsPerFile=archive_records).text(path)


RECORD_SCHEMA = "record_id string, type string, url string, page_id long, refers_to long, digest string, revisited_length long, origin string, segment int, total long, block binary"


def parse_records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an uncompressed WARC stream. ValueError if the stream ends inside one."""
    held = b""
    while True:
        while (head := held.find(b"\r\n\r\n")) < 0:
            if not (more := next(stream, b"")):
                if held.strip(b"\r\n"):
                    raise ValueError("an archive ends inside a record")
                return
            held += more
        lines = held[:head].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record starts with {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        parts, have = [held], len(held)
        while have < head + 4 + size + 4:
            if not (more := next(stream, b"")):
                raise ValueError("an archive ends inside a record")
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        if held[head + 4 + size : head + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")
        yield fields, held[head + 4 : head + 4 + size]
        held = held[head + 8 + size :]


def _inflated(content: bytes) -> Iterator[bytes]:
    """The members of a gzip file, in pieces of bounded size."""
    unzip = zlib.decompressobj(31)
    data = memoryview(content)
    for lo in range(0, len(data), 1 << 18):
        piece = bytes(data[lo : lo + (1 << 18)])
        while piece:
            yield unzip.decompress(piece)
            piece = b""
            if unzip.eof:
                piece, unzip = unzip.unused_data, zlib.decompressobj(31)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    number = lambda fields, k: int(fields[k]) if fields.get(k) else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]]) for n, x in zip(names, RECORD_SCHEMA.split(", "), strict=True)])
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for fields, block in parse_records(_inflated(content.as_py())):
                    digest = (fields.get("WARC-Payload-Digest") or "sha1:").removeprefix("sha1:") or None
                    rows.append((fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Target-URI"), number(fields, "WARC-Page-ID"), number(fields, "WARC-Refers-To-Page-ID"), digest, number(fields, "WARC-Revisited-Length"), fields.get("WARC-Segment-Origin-ID"), number(fields, "WARC-Segment-Number"), number(fields, "WARC-Segment-Total-Length"), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, RECORD_SCHEMA)


def reassemble(records: DataFrame) -> DataFrame:
    """page_id, url, type, refers_to, digest, revisited_length, payload: one row per logical record.

    Continuations are grouped by their origin's record id and ordered by segment number. The numbers must run from 1
    without a gap and the blocks must have the total length that the last one states; then the chunked framing is
    decoded and the payload held against the digest. A record that fails raises an error. Whole records are not shuffled;
    a group is one page's segments.
    """
    schema = "page_id long, url string, type string, refers_to long, digest string, revisited_length long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kept = ["page_id", "url", "type", "refers_to", "digest", "revisited_length"]
    whole = records.where("segment is null").select(*kept, "block")
    parts = records.where("segment is not null").select(F.coalesce("origin", "record_id").alias("origin"), F.struct("segment", "total", "block", *kept).alias("s"))
    grouped = parts.groupBy("origin").agg(F.array_sort(F.collect_list("s"), lambda a, b: a["segment"] - b["segment"]).alias("s"))
    sized = grouped.select("s", F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"])).alias("length"), F.element_at("s", -1)["total"].alias("total"))
    gap = F.exists(F.transform("s", lambda x, i: x["segment"] != i + 1), lambda x: x)
    sized = sized.withColumn("broken", gap | F.col("total").isNull() | (F.col("total") != F.col("length")))
    checked = sized.select("s", F.when(F.col("broken"), F.raise_error(F.concat(F.lit("segments do not add up for page "), F.coalesce(F.element_at("s", 1)["page_id"].cast("string"), F.lit("?"))))).otherwise(F.lit(1)).alias("fine"))
    joined = checked.where("fine = 1").select(*[F.element_at("s", 1)[k].alias(k) for k in kept], F.array_join(F.transform("s", lambda x: x["block"].cast("string")), "").cast("binary").alias("block"))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, digest, block in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(6).to_pylist(), strict=True):
                head = block.index(b"\r\n\r\n") + 4
                if kind == "revisit":
                    out.append(None)
                    continue
                payload = dechunked(block[head:]) if b"transfer-encoding: chunked" in block[:head].lower() else block[head:]
                if digest and _base32_sha1(payload) != digest:
                    raise ValueError("a payload does not have its record's digest")
                out.append(payload)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.binary())], names=names)

    return whole.unionByName(joined).mapInArrow(body, schema)


def _base32_sha1(payload: bytes) -> str:
    from base64 import b32encode

    return b32encode(hashlib.sha1(payload).digest()).decode()


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, after writing pages as archives and reading them back.

    A revisit's payload is that of the response it refers to, which has the same digest.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, **options)
    found = reassemble(read_records(spark, path))
    return found.select("page_id", F.coalesce(F.octet_length("payload").cast("long"), F.col("revisited_length")).alias("payload_bytes"), F.coalesce(payload_digest(F.col("payload")), F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to"))
