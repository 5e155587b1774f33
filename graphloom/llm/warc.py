"""WARC archives from a chunked record table.

A page is one record. Its payload is streamed as rows of record identifier and chunk number: a payload over
CHUNK_BYTES becomes a WARC record of several segments (``continuation`` records), each with the digest of the payload
so far. Spark's text writer puts one segment a row into gzip archives of a bounded number of segments; the blank line
that ends a WARC record is the line separator. Reading inflates an archive piece by piece, digests payloads as they
come, and lets only the segments of oversized payloads meet again, in order, by record.

Defined results: null payloads are empty; equal payloads are one response (largest page_id) and revisits; payloads
shorter than ``least`` are always responses; null page_id counts as smallest; rows that repeat page_id and payload are
the same record, stored (and read back) as often as they come. A record is named by its page_id and payload digest, so
a revisit names the response that it refers to. Payloads may be of any length and hold any bytes. Empty tables give empty
results; other columns are not touched. Line breaks in a url are written as blanks; a null url is left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

CHUNK_BYTES = 64 << 10
#: Segments in an archive, at most: with CHUNK_BYTES this bounds what a reader holds of an archive.
ARCHIVE_SEGMENTS = 2048
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORDS = "record string, row string, page_id {}, record_type string, refers_to {}, chunk long, last boolean, payload_bytes long, declared string, payload_digest string, body binary"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the pages whose payload a page of a larger id repeats."""
    sizes = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).where(F.length("payload") >= least)
    digests = sizes.select("page_id", F.sha2("payload", 256).alias("sha"))
    most = digests.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return digests.join(most, "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()


def _record(page_id: object, digest: str) -> str:
    """Name of the record of a page and payload; a page_id may be any text."""
    return f"{'' if page_id is None else quote(str(page_id), safe='')}:{digest}"


def _segments(row: str, page_id: object, url: str | None, payload: memoryview, refers_to: object) -> Iterator[bytes]:
    """WARC records of one payload; ``row`` tells rows of the same record apart."""
    whole = hashlib.sha1()
    for at in range(0, len(payload), CHUNK_BYTES):
        whole.update(payload[at : at + CHUNK_BYTES])
    digest = _base32(whole.digest())
    record = _record(page_id, digest)
    head = [f"WARC-Date: {DATE}", f"X-Row: {row}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8"]
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(str(page_id), safe='')}")
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.splitlines()))

    def made(kind: str, name: str, lines: list[str], body: bytes) -> bytes:
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", *lines, f"Content-Length: {len(body)}"]
        return "\r\n".join(lines).encode() + END + body

    if refers_to is not None:
        yield made("revisit", record, [*head, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_record(refers_to, digest)}>", f"X-Payload-Length: {len(payload)}"], b"")
        return
    if len(payload) <= CHUNK_BYTES:
        yield made("response", record, head, bytes(payload))
        return
    so_far, chunks = hashlib.sha1(), -(-len(payload) // CHUNK_BYTES)
    for k in range(chunks):
        body = bytes(payload[k * CHUNK_BYTES : (k + 1) * CHUNK_BYTES])
        so_far.update(body)
        lines = [f"WARC-Segment-Number: {k + 1}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(body).digest())}", f"X-Digest-So-Far: sha1:{_base32(so_far.copy().digest())}"]
        if k:
            lines.append(f"WARC-Segment-Origin-ID: <urn:page:{record}>")
        if k + 1 == chunks:
            lines.append(f"WARC-Segment-Total-Length: {len(payload)}")
        yield made("continuation" if k else "response", f"{record}/{k + 1}" if k else record, head + lines, body)


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a record per page under ``path``."""
    roles = written(record_roles(pages, least), "roles").withColumnRenamed("page_id", "_page")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    # Spark sends the roles to all tasks if they are small, else the payloads move once
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.sha2("payload", 256) == F.col("sha"))
    rows = rows.join(roles, same, "left").select("page_id", "url", "payload", "refers_to", F.col("sha").isNotNull().alias("again"))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, urls, refers = (batch.column(k).to_pylist() for k in (0, 1, 3))
            again = batch.column(4).to_pylist()
            out, size = [], 0
            for i, key in enumerate(keys):
                payload = memoryview(batch.column(2)[i].as_buffer())
                for segment in _segments(f"{part}-{n}", key, urls[i], payload, refers[i] if again[i] else None):
                    out.append(segment)
                    size += len(segment)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = rows.mapInArrow(chunked, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_SEGMENTS).text(path)


def _parsed(content: bytes) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Headers and body pieces of each record of a gzip archive; bodies must be used up in turn."""
    inflate, at, held = zlib.decompressobj(31), 0, bytearray()

    def more() -> bool:
        nonlocal at, inflate
        while True:
            if inflate.eof:
                rest = inflate.unused_data
                if not rest and at >= len(content):
                    return False
                inflate = zlib.decompressobj(31)
                piece = inflate.decompress(rest, 1 << 16)
            elif inflate.unconsumed_tail:
                piece = inflate.decompress(inflate.unconsumed_tail, 1 << 16)
            elif at < len(content):
                piece = inflate.decompress(content[at : at + (1 << 15)], 1 << 16)
                at += 1 << 15
            else:
                return False
            if piece:
                held.extend(piece)
                return True

    def body(left: int) -> Iterator[bytes]:
        while left:
            if not held and not more():
                raise ValueError("the archive ends within a record")
            piece = bytes(held[:left])
            del held[: len(piece)]
            left -= len(piece)
            yield piece

    while held or more():
        while (end := held.find(END)) < 0:
            if not more():
                raise ValueError("the archive ends within a record's header")
        lines = bytes(held[:end]).decode().split("\r\n")
        del held[: end + len(END)]
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield headers, body(int(headers["Content-Length"]))
        while len(held) < len(END):
            if not more():
                raise ValueError("the archive ends within a record")
        del held[: len(END)]


def read_segments(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """The chunk table of the archives under ``path``; only segments of oversized payloads carry their bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for headers, body in _parsed(content.as_py()):
                    segment = int(headers.get("WARC-Segment-Number", 0))
                    digest, length, parts = hashlib.sha1(), 0, []
                    for piece in body:
                        digest.update(piece)
                        length += len(piece)
                        if segment:
                            parts.append(piece)
                    name = headers.get("WARC-Segment-Origin-ID", headers["WARC-Record-ID"])[10:-1]
                    revisit = headers["WARC-Type"] == "revisit"
                    declared = headers["WARC-Payload-Digest"][5:]
                    out.append({
                        "record": name, "row": headers["X-Row"], "page_id": unquote(headers["X-Page-ID"]) if "X-Page-ID" in headers else None, "record_type": "revisit" if revisit else "response",
                        "refers_to": unquote(headers["WARC-Refers-To"][10:-1].rpartition(":")[0]) if revisit else None, "chunk": segment, "last": "WARC-Segment-Total-Length" in headers,
                        "payload_bytes": int(headers["X-Payload-Length"]) if revisit else length, "declared": declared,
                        "payload_digest": declared if revisit else _base32(digest.digest()), "body": b"".join(parts) if segment else None,
                    })
                    size += len(parts and out[-1]["body"] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, pa.schema(schema))
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, pa.schema(schema))
        yield pa.RecordBatch.from_pylist([], pa.schema(schema))

    schema = [pa.field(n, t) for n, t in (("record", pa.string()), ("row", pa.string()), ("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("declared", pa.string()), ("payload_digest", pa.string()), ("body", pa.binary()))]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    rows = files.mapInArrow(read, RECORDS.format("string", "string"))
    return rows.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def read_archives(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    The digest and length are those of the bytes read; ``intact`` tells if they agree with the headers.
    """
    segments = read_segments(spark, path, kind)
    whole = segments.where("chunk = 0").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("payload_digest") == F.col("declared")).alias("intact"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, length, expected = None, hashlib.sha1(), 0, 1
        for batch in batches:
            out = []
            for record, row, page, chunk, last, declared, body in zip(*(batch.column(k) for k in range(7))):
                if (record.as_py(), row.as_py()) != name:
                    name, digest, length, expected = (record.as_py(), row.as_py()), hashlib.sha1(), 0, 1
                digest.update(body.as_buffer())
                length += len(body.as_buffer())
                in_turn, expected = chunk.as_py() == expected, expected + 1
                if last.as_py():
                    text = _base32(digest.digest())
                    out.append((page.as_py(), length, text, in_turn and text == declared.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, [batch.schema.field(2).type, pa.int64(), pa.string(), pa.bool_()])], ["page_id", "payload_bytes", "payload_digest", "intact"])

    chunks = segments.where("chunk > 0").select("record", "row", "page_id", "chunk", "last", "declared", "body").repartition("record", "row").sortWithinPartitions("record", "row", "chunk")
    long = chunks.mapInArrow(joined, f"page_id {kind}, payload_bytes long, payload_digest string, intact boolean")
    long = long.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"), "intact")
    return whole.unionByName(long)
