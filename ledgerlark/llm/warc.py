"""WARC archives: writing with segments and revisits, reading with reassembly.

Writing: each page is a response whose block is an HTTP message with a chunked body. A
block over ``SEGMENT_BYTES`` is cut into a first record and continuation records that
name their origin, their number and, in the last, the total length. Of pages with equal
payloads only the first keeps it; the others become revisit records that refer to it.
The id of a response follows from page and digest, so a revisit can name it.
Files are gzipped WARC/1.1 streams that Spark's text writer makes in the shared folder,
with blank lines as its separator, so any store that Spark can write to will do.

Reading: records of one origin are grouped wherever they lie, ordered by segment number,
their total length is verified and the chunked framing decoded. Only segmented records
are shuffled, and the largest group is one page.

Defined cases: a null payload is empty; a null url leaves its header out; a null id comes
after all others when the first of equal payloads is chosen, and is read back as null;
repeated rows of the first page are responses both, equal in all
records and their ids, and are read back as often as they were written. ``read_pages`` raises if a segment is
missing or a length or digest differs.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored

SEGMENT_BYTES = 16_384
CHUNK_CHARS = 4_096
RECORDS_PER_FILE = 4_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT, CONTINUATION = "response", "revisit", "continuation"
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(text: str, size: int = CHUNK_CHARS) -> str:
    """Chunked transfer framing; chunks end between characters."""
    chunks = (text[i : i + size] for i in range(0, len(text), size))
    return "".join(f"{len(c.encode()):x}\r\n{c}\r\n" for c in chunks) + "0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        if len(parts[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + size


def segments(block: str, size: int = SEGMENT_BYTES) -> list[str]:
    """Parts of at most ``size`` bytes each, cut between characters."""
    data, parts, at = block.encode(), [], 0
    while len(data) - at > size:
        end = at + size
        while data[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(data[at:end].decode())
        at = end
    return [*parts, data[at:].decode()]


def _record(kind: str, fields: list[tuple[str, object]], block: str) -> str:
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("Content-Length", len(block.encode()))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n" + block


def records(page_id: str, url: str | None, text: str, first: str | None, serial: str, size: int) -> list[str]:
    """All records of one page, without the blank lines that end them."""
    payload = text.encode()
    if url is not None:
        url = url.encode().decode("ascii", "surrogateescape") if url.isascii() else url
        url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    digest = payload_digest(payload)
    own = f"<urn:page:{page_id}:{digest}>"
    common = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is not None:
        refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{first}:{digest}>")]
        fields = [("WARC-Record-ID", f"<urn:page:{page_id}:{digest}:{serial}>"), *common, *refers, ("WARC-Payload-Length", len(payload))]
        return [_record(REVISIT, fields, "")]
    parts = segments(_HTTP + chunked(text), size)
    fields = [("WARC-Record-ID", own), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(parts) == 1:
        return [_record(RESPONSE, fields, parts[0])]
    out = [_record(RESPONSE, [*fields, ("WARC-Segment-Number", 1)], parts[0])]
    total = sum(len(p.encode()) for p in parts)
    for n, part in enumerate(parts[1:], 2):
        last = ("WARC-Segment-Total-Length", total if n == len(parts) else None)
        fields = [("WARC-Record-ID", f"<urn:page:{page_id}:{digest}:{n}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), last]
        out.append(_record(CONTINUATION, fields, part))
    return out


def write_pages(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
    min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Write the archives of ``pages`` under ``path``. Payloads of fewer than
    ``min_bytes`` bytes are never replaced by revisits."""
    rows = pages.select(
        F.col(f"`{key}`").cast("string").alias("id"),
        F.col(f"`{key}`").alias("page"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("text"),
    ).withColumn("digest", F.when(F.octet_length("text") >= min_bytes, F.sha1("text")))
    firsts = rows.where(F.col("digest").isNotNull()).groupBy(F.col("digest").alias("_digest"))
    firsts = firsts.agg(F.min("page").cast("string").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    rows = rows.join(small(stored(firsts, "firsts")), F.col("digest") == F.col("_digest"), "left")
    rows = rows.select("id", "url", "text", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page_id, link, text, first in batch.itertuples(index=False):
                out += records(page_id if page_id is not None else "", link, text, first, f"{task}.{row}", segment_bytes)
                row += 1
            yield pd.DataFrame({"value": out}, dtype=object)

    written = rows.mapInPandas(run, "value string").write.option("lineSep", _END).option("compression", "gzip")
    written.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _parse(content: bytes, segmented: bool) -> Iterator[tuple]:
    data, at = gzip.decompress(content), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("no record here")
        head = dict(line.split(": ", 1) for line in lines[1:])
        block = end + 4
        at = block + int(head["Content-Length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("record of another length")
        number = int(head.get("WARC-Segment-Number", 0))
        if segmented == (number > 0):
            yield head, number, data[block:at]
        at += 4


def read_records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """Records that are segments, or all others: ``origin, page, type, digest, refers_to,
    length, number, total, block``. One file at a time is in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["origin", "page", "type", "digest", "refers_to", "length", "number", "total", "block"]
        for batch in batches:
            for content in batch["content"]:
                out = []
                for head, number, block in _parse(content, segmented):
                    own = head["WARC-Record-ID"]
                    refers, total, length = (head.get(k) for k in ("WARC-Refers-To", "WARC-Segment-Total-Length", "WARC-Payload-Length"))
                    out.append((
                        head.get("WARC-Segment-Origin-ID", own), own[1:-1].split(":")[2] or None, head["WARC-Type"],
                        head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
                        refers and refers[1:-1].split(":")[2], length and int(length), number, total and int(total), block,
                    ))
                    if len(out) == 500:
                        yield pd.DataFrame(out, columns=names).astype(object)
                        out = []
                yield pd.DataFrame(out, columns=names).astype(object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "origin string, page string, type string, digest string, refers_to string, length long, number int, total long, block binary")


def read_pages(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """``(page_id, payload, payload_bytes, payload_digest, record_type, refers_to)`` of
    all archives under ``path``; ``payload`` is null for revisits."""
    whole = read_records(spark, path, False).select(
        "page", "type", "digest", "refers_to", "length", F.lit(None).cast("long").alias("total"), F.array("block").alias("blocks"), F.lit(True).alias("complete")
    )
    part = F.struct("number", "block")
    # Repeated rows have equal segments, of which one of each is kept.
    grouped = read_records(spark, path, True).groupBy("origin").agg(
        F.max("page").alias("page"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.array_sort(F.collect_set(part)).alias("s"),
        F.count_if(F.col("number") == 1).alias("copies"),
    )
    numbers = F.transform("s", lambda s: s["number"])
    joined = grouped.select(
        "page", F.lit(RESPONSE).alias("type"), "digest", F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("long").alias("length"),
        "total", F.transform("s", lambda s: s["block"]).alias("blocks"),
        (F.col("total").isNotNull() & (numbers == F.sequence(F.lit(1), F.size("s")))).alias("complete"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)).cast("int"))).alias("_copy"),
    ).drop("_copy")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, kind, digest, refers_to, length, total, blocks, complete in batch.itertuples(index=False):
                if kind == REVISIT:
                    out.append((page, None, int(length), digest, kind, refers_to))
                    continue
                message = b"".join(bytes(b) for b in blocks)
                if not complete or (not pd.isna(total) and len(message) != total):
                    raise ValueError(f"page {page}: segments are missing")
                payload = unchunked(message[message.index(b"\r\n\r\n") + 4 :])
                if payload_digest(payload) != digest:
                    raise ValueError(f"page {page}: another digest")
                out.append((page, payload, len(payload), digest, kind, None))
            yield pd.DataFrame(out, columns=["page", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype(object)

    pages = whole.unionByName(joined).mapInPandas(
        run, "page string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"
    )
    return pages.select(
        F.col("page").cast(key_type).alias("page_id"), "payload", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(key_type).alias("refers_to")
    )
