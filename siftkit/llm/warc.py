"""WARC archives with revisit resolution.

``deduplicate`` merges record headers by payload digest, names the smallest page_id of each
group of equal payloads the original and turns the others into revisits; ``write_archives`` writes the records with fresh headers as WARC 1.1 files;
``read_archives`` parses archives by Content-Length; ``resolve_revisits`` joins revisit
records to the responses they refer to.

Archives are gzip streams written by Spark's text writer: a record is one value and the
writer's line separator is the blank line pair that ends a WARC record.  So Spark's commit
protocol holds, and a retried task leaves no half archive.  Files hold at most
``RECORDS_PER_FILE`` records.  They are read as a stream of the lines that this separator
ends, from which records are put together again, so a task holds one record and one Arrow
batch, however long its archives are.

Scale: headers of equal payloads are merged in the scan tasks before the shuffle.  The join
back takes hot digests by broadcast and shuffles all other payloads once, at every size
(adaptive execution leaves that out where no other payload repeats).

Defined results: null payload is empty.  Payloads under ``LEAST_BYTES`` are never revisits.
A null page_id comes last in a group; it can be a revisit, and a group of null ids only has
responses only.  Rows that repeat a page_id with the same payload are records of the same
kind.  A null url leaves the target header out.  Extra columns are not archived.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import skew_join, written

LEAST_BYTES = 100
RECORDS_PER_FILE = 10_000
#: A batch of records with their blocks is passed on beyond this.
BATCH_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = ("record_id string, record_type string, page_id long, target_uri string, refers_to_id string, "
          "payload_digest string, payload_bytes long, block binary")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``(page_id, url, payload, payload_digest, payload_bytes)`` of a table of pages."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"),
                        F.sha2(body, 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))


def deduplicate(recs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``recs`` with ``record_type`` (response or revisit) and ``refers_to`` (the response's page_id)."""
    headers = written(recs.select("page_id", "payload_digest", "payload_bytes"), "warc-headers")
    first = headers.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest") \
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    first = written(first, "warc-originals")
    # merged at every size: a broadcast on small inputs alone would hide that the payloads move
    rows = skew_join(recs, first.hint("merge"), "payload_digest", "copies", headers.count())
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select("page_id", "url", "payload", "payload_digest", "payload_bytes",
                       F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                       F.when(revisit, F.col("first_id")).alias("refers_to"))


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("-")), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(*lines: tuple[str, Column]) -> Column:
    """Header lines without those whose value is null, and the blank line after them."""
    made = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in lines]
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *made), F.lit(CRLF * 2))


def write_archives(recs: DataFrame, path: str, date: str = DATE) -> None:
    """Write the rows of ``deduplicate`` as gzipped WARC files under ``path``."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    uri = F.regexp_replace("url", r"[\x00-\x20]+", "%20")
    header = _header(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        ("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to"), F.col("payload_digest")))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("X-Page-ID", F.col("page_id")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(http) + F.octet_length(body)))
    recs.select(F.concat(header.cast("binary"), http.cast("binary"), body).cast("string").alias("value")) \
        .write.option("lineSep", CRLF * 2).option("compression", "gzip") \
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class RecordStream:
    """Records out of pieces of an archive: ``feed`` gives headers (lower-case names) and block of each that is complete."""

    def __init__(self):
        self.held, self.header, self.need = bytearray(), None, 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += piece
        while True:
            if self.header is None:
                at = self.held.find(b"WARC/")
                end = self.held.find(END, at) if at >= 0 else -1
                if end < 0:
                    return
                lines = self.held[at:end].decode("utf-8", "replace").split(CRLF)[1:]
                self.header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                self.need = int(self.header["content-length"])
                del self.held[:end + len(END)]
            if len(self.held) < self.need:
                return
            done, self.header = (self.header, bytes(self.held[:self.need])), None
            del self.held[:self.need]
            yield done


def http_payload(block: bytes, content_type: str) -> bytes:
    """The block without the HTTP head, if it has one."""
    return block.partition(b"\r\n\r\n")[2] if content_type.startswith("application/http") else block


def _row(h: dict[str, str], block: bytes, with_block: bool) -> tuple:
    payload = http_payload(block, h.get("content-type", ""))
    response = h.get("warc-type") == "response"
    page = h.get("x-page-id")
    return (h.get("warc-record-id"), h.get("warc-type"), None if page is None else int(page),
            h.get("warc-target-uri"), h.get("warc-refers-to"),
            hashlib.sha256(payload).hexdigest() if response else h.get("warc-payload-digest", "").removeprefix("sha256:"),
            len(payload) if response else None, payload if with_block else None)


def _parse(with_block: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, rows, held = RecordStream(), [], 0
        for batch in batches:
            for line in batch.column("line"):
                for h, block in stream.feed(line.as_py() + END):  # the separator that the reader took
                    rows.append(_row(h, block, with_block))
                    held += len(block) if with_block else 0
                    if len(rows) == 1000 or held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        yield _batch(rows)
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in PARSED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def read_archives(spark: SparkSession, path: str, with_block: bool = False) -> DataFrame:
    """One row a record of the gzipped archives under ``path``; digests of responses are taken from their bytes.

    A gzip file is never cut, so one task gets its lines in order.
    """
    lines = spark.read.option("lineSep", CRLF * 2).text(path).select(F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_parse(with_block), PARSED)


def resolve_revisits(recs: DataFrame) -> DataFrame:
    """Rows of ``read_archives`` with the original's page_id, digest and length on each revisit.

    A revisit whose original is not among the rows keeps null there.
    """
    recs = written(recs.drop("block"), "warc-read")
    asked = recs.where("record_type = 'revisit'").groupBy(F.col("refers_to_id").alias("id")).agg(F.count("*").alias("asked"))
    originals = recs.where("record_type = 'response'").groupBy(F.col("record_id").alias("id")).agg(
        F.min("page_id").alias("original_page"), F.min("payload_digest").alias("original_digest"),
        F.min("payload_bytes").alias("original_bytes"))
    originals = written(originals.join(asked, "id"), "warc-asked").withColumnRenamed("id", "refers_to_id")
    rows = skew_join(recs, originals, "refers_to_id", "asked", recs.count())
    revisit = F.col("record_type") == "revisit"
    return rows.select(
        "page_id", "record_type", "target_uri",
        F.when(revisit, F.col("original_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("original_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(revisit, F.col("original_page")).alias("refers_to"))
