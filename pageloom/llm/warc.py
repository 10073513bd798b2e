"""WARC archives of page captures: writing them, and assembling transactions from their records.

Writing is a table of text: a record is one row, its end is the line separator, so each task writes whole
records as it goes. Reading streams an archive member by member. Assembly joins request and metadata
records to responses (or revisits) by their concurrent-to identifiers into one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.storage import Scratch

CRLF = "\r\n"
# Digits of base 32 in the two alphabets.
BASE32_CONV, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
# Captures in one file; a reader holds one record at a time, so this only bounds the size of files.
PER_FILE = 20_000


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 20 bits of the hexadecimal form are four digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), BASE32_CONV, BASE32)


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Per distinct page_id and digest of ``pages``: the page it revisits, or null for a response.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response. Rows with the same
    page_id and payload are all responses or all revisits.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", digest(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"))
    best = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
    twice = best.where("n > 1").select("digest", "best")
    # Only digests that occur twice or more have revisits; page_id spreads what one digest would gather.
    found = rows.where(F.col("size") >= least).join(twice, "digest")
    found = found.where(~F.col("page_id").eqNullSafe(F.col("best")))
    return found.select("page_id", "digest", F.col("best").alias("refers_to")).distinct()


def _record(kind: Column | str, ident: Column, fields: list[Column], block: Column) -> Column:
    """One record without its end: version, header fields (null ones are left out), block."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), ident),
        F.lit(f"WARC-Date: {DATE}"),
        *fields,
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), block)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record_texts(pages: DataFrame, least: int = 0) -> DataFrame:
    """The records of each page, in order: request, response or revisit, metadata; a column ``value``."""
    again = revisits(pages, least).select(
        F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), F.col("refers_to").alias("__refers")
    )
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("__html"))
    rows = rows.withColumn("__own", digest(F.col("__html").cast("binary")))
    rows = rows.join(
        again, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("__own") == F.col("__digest")), "left"
    )
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    # A line end inside a field would end it.
    safe = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    uri = F.concat(F.lit("WARC-Target-URI: "), safe)
    ids = {k: _uuid(F.lit(k), F.col("page_id"), F.col("__own"), F.col("__row")) for k in ("request", "capture", "metadata")}
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), ids["capture"])
    hexed = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("__own"))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    revisit = F.col("__digest").isNotNull()
    kind = F.when(revisit, "revisit").otherwise("response")
    profile = F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: page:"), F.col("__refers").cast("string")))
    content = F.lit("Content-Type: application/http; msgtype=response")
    block = F.concat(F.lit(http), F.when(revisit, F.lit("")).otherwise(F.col("__html")))
    size = F.concat(F.lit("payload-bytes: "), F.octet_length("__html").cast("string"))
    page = F.concat(F.lit("page-id: "), F.col("page_id").cast("string"))
    asked = F.concat(F.lit("GET / HTTP/1.1\r\n\r\n"))
    records = F.array(
        _record("request", ids["request"], [uri, concurrent, F.lit("Content-Type: application/http; msgtype=request")], asked),
        _record(kind, ids["capture"], [uri, hexed, profile, refers, content], block),
        _record(
            "metadata",
            ids["metadata"],
            [uri, concurrent, F.lit("Content-Type: application/warc-fields")],
            F.concat(F.concat_ws(CRLF, page, size), F.lit(CRLF)),
        ),
    )
    return rows.select(F.explode(records).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a request, a response or revisit and a metadata record per row of ``pages(page_id, url, html)``."""
    writer = record_texts(pages, least).write.option("lineSep", CRLF * 2).option("compression", "gzip")
    writer.option("maxRecordsPerFile", 3 * PER_FILE).text(path)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an uncompressed stream."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(held) + 1):
                return
            end = held.find(b"\r\n\r\n")
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(head.get("content-length", 0))
        if not fill(end + 4 + size):
            raise ValueError("the archive ends inside a record")
        yield head, bytes(held[end + 4 : end + 4 + size])
        fill(end + 8 + size)
        del held[: end + 8 + size]


def _unzipped(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """A gzip stream of one or more members, in pieces."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    unzip = zlib.decompressobj(31)
    for k in range(0, len(raw), step):
        piece = raw[k : k + step]
        while piece:
            out = unzip.decompress(piece)
            if out:
                yield out
            piece = unzip.unused_data
            if unzip.eof and piece:
                unzip = zlib.decompressobj(31)
            elif not unzip.eof:
                break


RECORD = (
    "id string, kind string, uri string, concurrent_to string, refers_to string, payload_digest string,"
    " n_bytes long, computed_digest string, http_headers string, payload binary"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives at ``path``. Digests are computed from the payload that was read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows: list[tuple] = []
                held = 0
                for head, block in records(_unzipped(raw.as_buffer().to_pybytes())):
                    kind = head.get("warc-type")
                    http, payload = b"", block
                    if head.get("content-type", "").startswith("application/http"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append(
                        (
                            head.get("warc-record-id"),
                            kind,
                            head.get("warc-target-uri"),
                            head.get("warc-concurrent-to"),
                            head.get("warc-refers-to"),
                            head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            len(payload),
                            sha,
                            http.decode("latin-1"),
                            payload,
                        )
                    )
                    held += len(payload)
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(work, RECORD)


_NAMES = [part.split()[0] for part in RECORD.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: nested ``capture``, ``request`` and ``metadata`` records.

    A capture without request or metadata has null there. Identifiers are unique, so no key is hot.
    """
    main = found.where(F.col("kind").isin("response", "revisit"))
    side = found.where("concurrent_to is not null")
    request = side.where("kind = 'request'").select(
        F.col("concurrent_to").alias("rid"), F.struct("id", "uri", "http_headers").alias("request")
    )
    fields = F.str_to_map(F.rtrim(F.col("payload").cast("string")), F.lit("\r\n"), F.lit(": "))
    metadata = side.where("kind = 'metadata'").select(
        F.col("concurrent_to").alias("mid"), F.struct("id", fields.alias("fields")).alias("metadata")
    )
    rows = main.join(request, main.id == F.col("rid"), "left").join(metadata, main.id == F.col("mid"), "left")
    capture = F.struct(
        "id", "kind", "uri", "refers_to", "payload_digest", "computed_digest", "n_bytes", "http_headers", "payload"
    )
    return rows.select(capture.alias("capture"), "request", "metadata")


def captures(pages: DataFrame, scratch: Scratch, least: int = 0, payloads: bool = True) -> DataFrame:
    """Write ``pages`` as archives, read them back once, and return assembled captures.

    The records that were read are stored as a table, from which the assembly takes its three sides;
    without ``payloads`` those of responses are left out of it (lengths and digests stay).

    Null html is an empty payload; a null url leaves out the target field; a null page_id is not written and
    comes back null. Repeated rows are captures of their own, the equal ones all response or all revisit.
    Long texts stream through. An empty table gives no archive rows. Other columns are not looked at.
    """
    path = scratch.path("archives")
    write_archives(pages, path, least)
    found = read_records(pages.sparkSession, path)
    if not payloads:
        found = found.withColumn("payload", F.when(F.col("kind") == "metadata", F.col("payload")))
    return assemble(scratch.save(found, "records"))
