"""WARC archives in which repeated payloads are revisit records.

Headers (id, digest, length) are shuffled by payload digest and reduced to each digest's first
page; every later page becomes a revisit of it. Only then are pages joined, by their own key, to
what they revisit, and written with fresh headers. Spark's text writer makes the archives: a
record is one value, and the two line ends that close a WARC record are its line separator, so
any store that Spark writes to will do. Its gzip makes one member of a file, not one of each record: tools
that seek in an archive need it unpacked or packed anew. Reading decodes each archive as a stream of records.

Scale: the reduction of digests is a grouped minimum, and the first page of a digest that many pages share goes to
all tasks, so a payload that a third of all pages share meets in no task. Payloads move once, dealt by page and digest to as
many files as hold about FILE_BYTES each, so a reader's memory is bounded by that, a page and its record.

Edge cases: null html is an empty payload; payloads under 100 bytes are never revisits; rows that
repeat a page_id with an equal payload are all responses if theirs is the smallest id; a record's id names
page, digest and url, so only rows alike in all three have it in common; a null
page_id is a response that nothing refers to; line ends in a url become spaces; an empty table
gives no records. Further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, parts, tune, with_facts

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])
_EOL = "\r\n"
#: Unpacked bytes of an archive, on average; about what a record has besides its payload.
FILE_BYTES, HEAD_BYTES = 32 << 20, 700


def resolve(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, and refers_to with the id and url of what they revisit (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    clean = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ")
    full = pages.select("page_id", clean.alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("payload_digest"))
    # at least the session's partitions, or the join would deal the payloads anew
    files = parts(pages.sparkSession, full.agg(F.sum(F.col("payload_bytes") + HEAD_BYTES)).first()[0] or 0, FILE_BYTES)
    heads = materialize(full.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "url", "payload_digest"), "heads")
    first = heads.groupBy("payload_digest").agg(F.min(F.struct("page_id", "url")).alias("f"), F.max("page_id").alias("top"), F.count("*").alias("c")).where(F.col("top") > F.col("f.page_id"))
    later = with_facts(heads.select("page_id", "payload_digest"), materialize(first, "first"), "payload_digest").where(F.col("page_id") > F.col("f.page_id"))
    later = later.groupBy("page_id", "payload_digest").agg(F.first("f").alias("f")).withColumnsRenamed({"page_id": "pid", "payload_digest": "pd"})
    dealt = full.repartition(files, "page_id", "payload_digest")
    return dealt.join(later, (F.col("page_id") == F.col("pid")) & (F.col("payload_digest") == F.col("pd")), "left").select(*full.columns, F.col("f.page_id").alias("refers_to"), F.col("f.url").alias("target_uri"))


def records(resolved: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column, value: the WARC record of each row, without the two line ends after it."""
    revisit = F.col("refers_to").isNotNull()
    # a revisit has the digest of what it refers to
    page = lambda c, url: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(":"), "payload_digest", F.lit(":"), F.hex(F.xxhash64(url)), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_EOL * 2))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit(""))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    value = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", page(F.col("page_id"), F.col("url"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT))),
        line("WARC-Refers-To", F.when(revisit, page(F.col("refers_to"), F.col("target_uri")))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("target_uri"))),
        F.lit(f"Content-Type: application/http; msgtype=response{_EOL}"),
        line("Content-Length", length.cast("string")),
        F.lit(_EOL),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    return resolved.select(value.alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100) -> None:
    records(resolve(pages, least_bytes)).write.option("lineSep", _EOL * 2).option("compression", "gzip").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    """The records of one decompressed archive: headers with lower-case names, and the block."""
    while first := stream.readline():
        if first == b"\r\n":
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = {}
        while (one := stream.readline()) not in (b"\r\n", b""):
            name, _, value = one.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield head, block


def _number(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").partition(":")[0] if urn else ""
    return int(number) if number else None


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows: list[tuple] = []
            for head, block in parse(gzip.GzipFile(fileobj=io.BytesIO(batch.column(0)[i].as_py()))):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(next(x for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:"))[15:])
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                if head["warc-type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
                rows.append((_number(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, head["warc-type"], _number(head.get("warc-refers-to")), head.get("warc-refers-to-target-uri")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; each response's payload is checked against its digest."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(_parse_batches, SCHEMA)


def round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Writes pages as archives in the shared folder and returns what reading them gives."""
    spark = pages.sparkSession
    tune(spark)
    path = new_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id > first_id AND payload_bytes >= 100 THEN first_id END AS refers_to FROM p LEFT JOIN m USING (payload_digest)
"""
