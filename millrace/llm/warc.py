"""WARC archives: write captures, read records back, assemble transactions."""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_END = "\r\n"
_RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, "
    "payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
)


def _urn(kind: str, *of):
    """A record id that is the same whenever the same page is written."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("-")) for c in of]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list, block):
    """One record without the blank line that ends it; null headers are left out."""
    head = F.concat_ws(_END, F.lit("WARC/1.1"), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block)))
    return F.concat(head, F.lit(_END * 2), block)


def _header(name: str, value):
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))


def duplicate_payloads(pages: DataFrame, id_col: str, digest_col: str, bytes_col: str, least: int) -> DataFrame:
    """(digest, first_id) of payloads of at least `least` bytes that several rows carry."""
    return (
        pages.where(F.col(bytes_col) >= least)
        .groupBy(F.col(digest_col).alias("dup_digest"))
        .agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
        .drop("n")
    )


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = 100,
    captures_per_file: int = 1500,
) -> None:
    """Write a response or revisit, a request and a metadata record for each row.

    Payloads are the UTF-8 bytes of `payload_col` (null: empty). Of rows with
    equal payloads of at least `revisit_bytes` bytes, the one with the smallest
    id is a response and the others revisit it; smaller payloads are all
    responses. Request and metadata records name the capture's principal record
    in WARC-Concurrent-To. A null id never becomes a response that others refer
    to. Line breaks in a URL are percent-encoded; a null URL leaves its header
    out. The sink is Spark's text writer with the blank line that ends a WARC
    record as its line separator, so archives reach any file system that Spark
    writes to; each part file is one gzip stream of `captures_per_file` captures.
    """
    url = F.regexp_replace(F.regexp_replace(F.col(f"`{url_col}`").cast("string"), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"), url.alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("body")
    )
    rows = rows.withColumns({"digest": F.sha2("body", 256), "bytes": F.octet_length("body")})
    dups = duplicate_payloads(rows.select("id", "digest", "bytes"), "id", "digest", "bytes", revisit_bytes)
    rows = rows.join(dups.hint("shuffle_hash"), F.col("digest") == F.col("dup_digest"), "left")
    again = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    own = _urn("capture", F.col("id"), F.col("digest"))
    first = F.when(again, _urn("capture", F.col("first_id"), F.col("digest")))
    uri = _header("WARC-Target-URI", F.col("url"))
    date = F.lit("WARC-Date: 1970-01-01T00:00:00Z")
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), own)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(_END * 2))
    principal = _record(
        [
            F.when(again, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
            F.concat(F.lit("WARC-Record-ID: "), own),
            date,
            uri,
            F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
            _header("WARC-Refers-To", first),
            F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.lit("Content-Type: application/http;msgtype=response"),
        ],
        F.when(again, http).otherwise(F.concat(http, F.col("body"))),
    )
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z]+://([^/?#]*)", 1)
    target = F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-zA-Z]+://[^/?#]*", "")
    request = _record(
        [F.lit("WARC-Type: request"), F.concat(F.lit("WARC-Record-ID: "), _urn("request", F.col("id"), F.col("digest"))), date, uri, concurrent, F.lit("Content-Type: application/http;msgtype=request")],
        F.concat(F.lit("GET "), F.when(target == "", F.lit("/")).otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END * 2)),
    )
    field = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(_END)))
    metadata = _record(
        [F.lit("WARC-Type: metadata"), F.concat(F.lit("WARC-Record-ID: "), _urn("metadata", F.col("id"), F.col("digest"))), date, uri, concurrent, F.lit("Content-Type: application/warc-fields")],
        F.concat_ws("", field("pageId", F.col("id")), field("payloadLength", F.col("bytes")), field("refersToPage", F.when(again, F.col("first_id")))),
    )
    (
        rows.select(F.explode(F.array(principal, request, metadata)).alias("value"))
        .write.option("lineSep", _END * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 3 * captures_per_file)
        .text(path)
    )


def parse_records(data: bytes):
    """Yield (headers, block) of each record of an uncompressed WARC stream, by Content-Length.

    Header names are lower-cased. A stream that ends within a record raises ValueError.
    """
    at, end = 0, len(data)
    while at < end:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        begin = stop + 4
        finish = begin + int(headers["content-length"])
        if finish > end:
            raise ValueError("a WARC record is cut off")
        yield headers, data[begin:finish]
        at = finish + 4


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below `path`; payload is null unless `payloads`.

    payload_bytes and payload_digest of a response are taken from the payload
    itself; a digest that differs from the header's raises ValueError. A revisit
    has its header's digest and no payload_bytes. `fields` holds the lines of
    application/warc-fields blocks, null otherwise.
    """
    schema = pa.schema(
        [(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "payload_digest")]
        + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
    )

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in parse_records(gzip.decompress(content.as_py())):
                    kind = head.get("warc-type")
                    digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    n = fields = payload = None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        n, found = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest not in (None, found):
                            raise ValueError(f"payload digest of {head.get('warc-record-id')} differs")
                        digest = found
                    elif head.get("content-type") == "application/warc-fields":
                        fields = [(a.strip(), b.strip()) for a, _, b in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)]
                    rows.append([head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), digest, n, fields, payload if payloads else None])
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, _RECORD)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, principal, request, metadata.

    Records meet under the id that they are concurrent to, the capture's response
    or revisit; that one meets them under its own id. A record whose principal is
    missing gives a row without one. If a record occurs several times (a page
    written twice), its captures come back that many times.
    """
    kind = F.col("type")
    rows = records.select(
        F.coalesce("concurrent_to", "record_id").alias("capture_id"),
        F.when(kind.isin("response", "revisit"), F.lit("principal")).when(kind == "request", F.lit("request")).when(kind == "metadata", F.lit("metadata")).alias("part"),
        F.struct(*records.columns).alias("record"),
    ).where("part is not null")
    parts = ("principal", "request", "metadata")
    grouped = rows.groupBy("capture_id").agg(*[F.collect_list(F.when(F.col("part") == p, F.col("record"))).alias(p) for p in parts])
    return grouped.select("capture_id", F.explode(F.arrays_zip(*parts)).alias("x")).select("capture_id", "x.*")
