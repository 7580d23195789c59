"""WARC archives without repeated payloads.

Payload digests are shuffled alone to find, of records with equal payloads, the one with the largest page id: it is
written as a response, the others as revisit records that refer to it and carry no payload. The archives are written by
Spark's text sink (WARC records of UTF-8 pages are text, and the sink's line end closes a record), so they reach any
store Spark reaches and are committed whole when executors are lost. Reading parses every file by the content lengths of
its records, recomputes the digests of payloads, and resolves revisits by joining them to their responses.

Defined cases: a null page is an empty payload; payloads below ``min_bytes`` are always responses; a null page id takes
part like any other but never wins over an id; rows that repeat the winning id with the same payload are all responses;
a null url leaves its header out, and line ends in a url become blanks; an empty table gives archives without records and
an empty result; further columns are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lessonlens.session import cut_lineage, scratch_path

# Fixed values of the WARC format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX_32, BASE_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


@dataclass(frozen=True)
class Archive:
    """``records_per_file`` and ``file_bytes``, which the largest page must not pass so many times over, keep files at a size that one
    task can read whole."""

    min_bytes: int = 0
    records_per_file: int = 4000
    file_bytes: int = 1 << 29
    codec: str = "gzip"
    prefix: str = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: five bytes, ten hex digits, are eight digits to the base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), HEX_32, BASE_32)


def resolved(pages: DataFrame, archive: Archive) -> tuple[DataFrame, int]:
    """(page_id, url, html, payload_digest, payload_bytes, original), the page id of the response for each payload; and the bytes
    of the largest payload."""
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("payload_digest", base32_sha1(F.col("html").cast("binary")))
    page = page.withColumn("payload_bytes", F.octet_length("html").cast("long"))
    first = cut_lineage(page.groupBy(F.col("payload_digest").alias("d_"), F.col("payload_bytes").alias("b_"))
                        .agg(F.max("page_id").alias("original")))
    rows = page.join(first, (F.col("payload_digest") == F.col("d_")) & (F.col("payload_bytes") == F.col("b_"))).drop("d_", "b_")
    return rows, first.agg(F.max("b_")).first()[0] or 0


def write_archives(pages: DataFrame, path: str, archive: Archive = Archive()) -> None:
    rows, largest = resolved(pages, archive)
    revisit = (F.col("payload_bytes") >= archive.min_bytes) & ~F.col("page_id").eqNullSafe(F.col("original"))
    # a response is named by its page and payload, so that revisits can refer to it; a revisit has a number of its own as well
    uri = lambda c, more: F.concat(F.lit(f"<{archive.prefix}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(":"), F.col("payload_digest"), more, F.lit(">"))
    own = F.when(revisit, F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string"))).otherwise("")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    url = F.concat(F.lit("WARC-Target-URI: "), F.translate("url", "\r\n", "  "), F.lit("\r\n"))
    refers = F.concat(F.lit("WARC-Refers-To: "), uri(F.col("original"), F.lit("")), F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\n"))
    record = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), uri(F.col("page_id"), own), F.lit("\r\n"), F.coalesce(url, F.lit("")),
        F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\n"), F.when(revisit, refers).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
        http, F.when(revisit, "").otherwise(F.col("html")), F.lit("\r\n"))
    per_file = max(1, min(archive.records_per_file, archive.file_bytes // (largest + 4096)))
    (rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", per_file)
     .option("compression", archive.codec).text(path))


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an open, decompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {line[:60]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode()
        yield headers, stream.read(int(headers["content-length"]))


def read_archives(spark: SparkSession, path: str, archive: Archive = Archive(), payloads: bool = True) -> DataFrame:
    """One row per record as written; a revisit's payload and its length are null until it is resolved."""
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def page_id(value: str | None) -> int | None:
        digits = (value or "").strip("<>").removeprefix(archive.prefix).partition(":")[0]
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.binary() if n == "payload"
                             else pa.string()) for n in names])
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                stream = gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                out: list[tuple] = []
                held = 0
                for headers, block in records(stream):
                    kind = headers["warc-type"]
                    _, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    size = len(payload) if kind == "response" else None
                    out.append((page_id(headers["warc-record-id"]), kind, headers.get("warc-target-uri"), digest, size,
                                page_id(headers.get("warc-refers-to")), payload if payloads and kind == "response" else None))
                    held += len(block) if payloads else 0
                    if len(out) >= 2000 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORDS)


def resolve_revisits(rows: DataFrame) -> DataFrame:
    """Archive records with the payload length of the response that a revisit refers to."""
    lengths = rows.where("record_type = 'response'").groupBy(
        F.col("page_id").alias("i_"), F.col("payload_digest").alias("d_")).agg(F.max("payload_bytes").alias("n_"))
    lengths = cut_lineage(lengths)
    # a response joins nothing: its key is null
    joined = rows.withColumn("to_", F.when(F.col("record_type") == "revisit", F.col("refers_to"))).join(
        lengths, (F.col("to_") == F.col("i_")) & (F.col("payload_digest") == F.col("d_")), "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "n_")).drop("to_", "i_", "d_", "n_")


def archive_report(pages: DataFrame, archive: Archive = Archive()) -> DataFrame:
    """Write the archives below the shared folder, read them back, and give one row per page."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, archive)
    rows = cut_lineage(read_archives(pages.sparkSession, path, archive, payloads=False).drop("payload"))
    return resolve_revisits(rows).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
