"""WARC archives: writing pages as transactions, reading archives back, assembling captures.

A capture is three records: request, response (or revisit) and metadata; request and metadata name the
response's identifier in WARC-Concurrent-To. Archives are plain WARC/1.1 files in the shared folder,
compressed with gzip, written by Spark's own writer, FILE_RECORDS records a file. They are read as a stream cut
at the version line, and put together again by each record's length, so a task holds one record at a time,
whatever the size of its archive. Reading joins the three kinds on the concurrent-to identifier into one
nested row per capture.

Defined results: a null html is an empty payload; a null or unusual url is written percent-encoded or
left out; of equal payloads the row with the largest page_id responds, a null one only where all are null, and
of rows that repeat it the first by url; every other one revisits it; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, ship, work_folder

FILE_RECORDS = 1500
CUT = b"\r\nWARC/1.1\r\n"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, digest_ok boolean, fields map<string,string>"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _record(headers: list[tuple[str, str | None]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n" + block.decode() + "\r\n"  # the writer ends the line again


def digests(pages: DataFrame) -> DataFrame:
    """page_id, sha1, sha256, payload_bytes."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(x.as_py() or "").encode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sha1_base32(d) for d in data], pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()), pa.array([len(d) for d in data], pa.int64())], names=["page_id", "sha1", "sha256", "payload_bytes"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string")).mapInArrow(run, "page_id long, sha1 string, sha256 string, payload_bytes long")


def write(pages: DataFrame, least_bytes: int = 0) -> str:
    """Write pages (page_id, url, html) as WARC files; the folder. Payloads of least_bytes or more are deduplicated."""
    spark = pages.sparkSession
    found = keep(digests(pages))
    repeated = found.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1", "sha256").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Which of the rows revisit: decided on the narrow rows, then joined to the html by page and payload.
    plan = found.select("page_id", "sha1", "sha256").distinct().join(repeated.withColumn("shared", F.lit(True)), ["sha1", "sha256"], "left").select("page_id", "sha256", "target", "shared")
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha256", F.sha2("html", 256))
    # One key for the window and the join, so that the html moves once.
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "sha256")
    order = Window.partitionBy("key").orderBy("url")
    plan = plan.select(key.alias("key"), "target", "shared")
    rows = page.withColumn("key", key).withColumn("nth", F.row_number().over(order)).join(plan, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "sha256", "nth", "target", "shared")), strict=True):
                page_id, url, body, sha256, nth, target, shared = (x.as_py() for x in row)
                body = body.encode()
                uri = None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]-._")
                response = record_id(page_id, sha256, nth)
                again = bool(shared) and (page_id != target or nth > 1)
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
                about = f"page-id: {'' if page_id is None else page_id}\r\npayload-bytes: {len(body)}\r\n".encode()
                if again:
                    about += f"refers-to-page: {'' if target is None else target}\r\n".encode()
                records = [
                    _record([("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", response), *common, ("WARC-Profile", PROFILE if again else None), ("WARC-Refers-To", record_id(target, sha256, 1) if again else None), ("WARC-Payload-Digest", f"sha1:{sha1_base32(body)}"), ("Content-Type", "application/http; msgtype=response")], http if again else http + body),
                    _record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("q", page_id, sha256, nth)), *common, ("WARC-Concurrent-To", response), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n"),
                    _record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("m", page_id, sha256, nth)), *common, ("WARC-Concurrent-To", response), ("Content-Type", "application/warc-fields")], about),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], names=["value"])

    folder = work_folder(spark)
    text = rows.select("page_id", "url", "html", "sha256", "nth", "target", "shared").mapInArrow(run, "value string")
    text.write.option("lineSep", "\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(folder)
    return folder


def records_of(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record, from an archive's bytes cut at CUT."""
    held = b""
    for line in lines:
        held = held + CUT + line if held else line.removeprefix(CUT[2:])
        end = held.find(b"\r\n\r\n")
        if end < 0:
            if held:
                raise ValueError("no WARC record where one should start")
            continue
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in held[:end].decode().split("\r\n"))}
        n = int(head["content-length"])
        if len(held) >= end + 4 + n:
            yield head, held[end + 4 : end + 4 + n]
            held = b""
    if held:
        raise ValueError("the archive ends inside a record")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in a folder."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.bool_(), pa.map_(pa.string(), pa.string())]
        names = ["type", "record_id", "concurrent_to", "refers_to", "target_uri", "payload_digest", "payload_bytes", "digest_ok", "fields"]
        rows = []
        for head, block in records_of(line.as_py() for batch in batches for line in batch.column(0)):
            kind, digest, payload = head["warc-type"], head.get("warc-payload-digest"), None
            if kind == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
            fields = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if x] if kind == "metadata" else []
            rows.append((kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), digest and digest.removeprefix("sha1:"), None if payload is None else len(payload), None if payload is None else f"sha1:{sha1_base32(payload)}" == digest, fields))
            if len(rows) == FILE_RECORDS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    lines = spark.read.option("lineSep", CUT.decode()).text(folder, pathGlobFilter="part-*")
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata. A capture without one of the latter has null there."""
    records = keep(records)
    whole = F.struct("*")
    answer = records.where("type IN ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    side = lambda kind: records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("capture_id"), whole.alias(kind))
    return answer.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")


def page_captures(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from written archives."""
    got = captures(read(pages.sparkSession, write(pages)))
    number = lambda k: F.expr(f"try_cast(try_element_at(metadata.fields, '{k}') as bigint)")
    return got.select(
        number("page-id").alias("page_id"),
        F.coalesce("response.payload_bytes", number("payload-bytes")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        number("refers-to-page").alias("refers_to"),
    )
