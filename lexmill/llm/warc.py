"""Operator 4: WARC archives with revisit resolution.

Headers (key, digest, length) are shuffled by payload digest, the smallest key
of each digest becomes the response and the others revisit it; the decisions
meet the payloads again on the key, so no payload travels by digest and a
payload that a third of all rows share costs no task more than others.  The
archives are WARC/1.1 files written by Spark's own text sink: a record ends
with two CRLFs, which is the sink's line separator.  Reading takes files whole
(``records_per_file`` bounds them) and checks every payload's digest.

Defined results: a null payload is empty; keys must be unique and not null; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import shared_dir

_CRLF = "\r\n"


def base32_sha1(payload: F.Column) -> F.Column:
    """Upper-case base32 SHA-1: each 5 hex digits (20 bits) become 4 base32 digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, check): no payload leaves its task."""
    return pages.select(
        "page_id",
        F.octet_length("html").cast("long").alias("payload_bytes"),
        base32_sha1(F.encode("html", "utf-8")).alias("payload_digest"),
        F.sha2("html", 256).alias("check"),
    )


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to) of the revisits.  The minimum per digest is combined
    before the shuffle; the join back is one Spark may split where a digest is hot."""
    long = heads.where(F.col("payload_bytes") >= min_bytes)
    first = long.groupBy("payload_digest", "check").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies"))
    first = first.where("copies > 1").drop("copies")
    return long.join(first, ["payload_digest", "check"]).where("page_id > refers_to").select("page_id", "refers_to")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One column ``value``: a WARC record without its closing CRLFs."""
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    heads = headers(pages)
    to = resolve(heads, min_bytes)
    rows = pages.join(to, "page_id", "left")
    revisit = F.col("refers_to").isNotNull()
    digest = base32_sha1(F.encode("html", "utf-8"))
    uri = F.regexp_replace("url", r"[\r\n]", "")
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{_CRLF}WARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"),
        F.lit(f">{_CRLF}WARC-Date: 1970-01-01T00:00:00Z{_CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(
            F.lit(f"{_CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.lit(f"{_CRLF}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"),
            F.lit(f">{_CRLF}X-Payload-Length: "), F.octet_length("html").cast("string"),
        )).otherwise(""),
        F.lit(f"{_CRLF}Content-Type: text/html{_CRLF}Content-Length: "),
        F.when(revisit, F.lit(0)).otherwise(F.octet_length("html")).cast("string"),
        F.lit(_CRLF + _CRLF),
    )
    return rows.select(F.concat(head, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 1000) -> None:
    sep = _CRLF + _CRLF
    records(pages, min_bytes).write.option("lineSep", sep).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(_CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) from the files;
    a revisit has no payload, its record names its original's size."""
    import gzip

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def number(urn: str) -> int:
            return int(urn.removeprefix("<urn:page:").removesuffix(">"))

        for b in batches:
            for blob in b["content"]:
                rows = []
                for head, payload in parse(gzip.decompress(blob.as_py())):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"digest of {head['WARC-Record-ID']} does not fit its payload")
                    to = number(head["WARC-Refers-To"]) if kind == "revisit" else None
                    size = len(payload) if to is None else int(head["X-Payload-Length"])
                    rows.append((number(head["WARC-Record-ID"]), size, digest, kind, to, payload.decode("utf-8", "surrogatepass") if to is None else None))
                    if len(rows) == 500:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read them back, one row per page."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path).drop("payload")
