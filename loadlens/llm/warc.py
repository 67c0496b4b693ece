"""WARC records as a content-addressed archive.

The archive is two tables: `payloads` holds the bytes of each different payload once, under their SHA-256; `headers` holds the
exact header bytes of each record (the WARC fields, then the HTTP fields) with the SHA-256 of its payload. Records are put
together again by joining the two. Nothing is taken on trust: payloads of one SHA-256 must have one SHA-1 and length when
they are stored, stored bytes must have the digest that they are stored under, and the SHA-1 in a record's header must be
that of the bytes read back; anything else fails the job.

Of records with equal payloads the one with the largest id is the response, and the others are revisits that refer to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep

# The profile of a revisit with an identical payload, the digits of base 32, and the version line.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
#: Payload bytes from which equal ones are stored as revisits; smaller ones are all responses.
LEAST_BYTES = 0
_CRLF = "\r\n"


def base32_of_hex(digits: Column) -> Column:
    """The 40 hexadecimal digits of a SHA-1 as 32 digits of base 32: five of the first make four of the second."""
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _urn(ident: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(F.url_encode(ident.cast("string")), F.lit("")), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A line of a header; empty for a null value. Line ends within a value are percent-encoded, so that it stays one line."""
    flat = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), flat, F.lit(_CRLF)), F.lit(""))


def _header(date: str) -> Column:
    """The header bytes of a row of id, url, owner, revisit, sha1 and n."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(_CRLF * 2))
    revisit = F.col("revisit")
    lines = (
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _urn(F.col("id"))),
        ("WARC-Target-URI", F.when(F.col("url") != "", F.col("url"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("owner")))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))).cast("string")),
    )
    return F.concat(F.lit(f"{VERSION}{_CRLF}"), *(_field(k, v) for k, v in lines), F.lit(_CRLF), http).cast("binary")


def _payload(column: str) -> Column:
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of a table with a record a row: id, sha256, header; and sha256, payload.

    A null payload is empty, a record without a url has no target line. Repeated rows give equal records, of which all are
    responses if one is; a record with a null id is a revisit where another with an id has its payload, else a response. Other
    columns are ignored; an empty table gives two empty ones.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), _payload(payload_col).alias("payload"))
    sha256 = F.unhex(F.sha2("payload", 256))
    # All but the payloads: what follows until they are stored moves digests only.
    facts = keep(rows.select("id", "url", sha256.alias("sha256"), base32_of_hex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n")), "warc-facts")
    one = (F.min("sha1") == F.max("sha1")) & (F.min("n") == F.max("n"))
    groups = facts.groupBy("sha256").agg(F.max("id").alias("owner"), F.count("*").alias("copies"), one.alias("one"))
    shared = groups.filter(F.col("copies") > 1).select("sha256", F.when(F.col("one"), F.col("owner")).otherwise(F.raise_error(F.lit("two payloads have one SHA-256"))).alias("owner"))
    # A table of its own, so that the join's two sides are plain exchanges, whose skewed partitions Spark splits.
    known = facts.join(keep(shared, "warc-shared"), "sha256", "left")
    revisit = F.col("owner").isNotNull() & (F.col("n") >= least) & ~F.col("owner").eqNullSafe(F.col("id"))
    headers = known.withColumn("revisit", revisit).select("id", "sha256", _header(date).alias("header"))
    return headers, rows.select(sha256.alias("sha256"), "payload").dropDuplicates(["sha256"])


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """id, record_type, refers_to, payload_bytes, payload_digest, header, payload: the archive's records, put together and verified.

    A revisit's payload is the one that it refers to. Only columns that are used are read and moved.
    """
    kind = headers.schema["id"].dataType
    intact = F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload isn't what its digest says")))
    stored = payloads.select("sha256", intact.alias("payload"))
    stored = stored.select("sha256", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"))
    text = F.col("header").cast("string")
    get = lambda name, rest: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {rest}\r\n", 1), F.lit(""))
    # A payload that is missing, too, leaves a digest that isn't the header's.
    same = F.coalesce(get("WARC-Payload-Digest", r"sha1:(\w+)") == F.col("payload_digest"), F.lit(False))
    digest = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's payload isn't the one that its header names")))
    return headers.join(stored, "sha256", "left").select(
        "id", get("WARC-Type", r"(\w+)").alias("record_type"), F.url_decode(get("WARC-Refers-To", "<urn:record:([^>]*)>")).cast(kind).alias("refers_to"),
        "payload_bytes", digest.alias("payload_digest"), "header", "payload",
    )


def write_archive(pages: DataFrame, path: str, **columns) -> None:
    """The two tables as Parquet under a path that all executors share."""
    headers, payloads = archive(pages, **columns)
    headers.write.parquet(f"{path}/headers")
    payloads.write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """records() of what write_archive() has written."""
    return records(spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads"))


def write_files(found: DataFrame, path: str) -> None:
    """records() as WARC files, one for each partition: header, the payload of a response, and the two line ends after a record."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    found.select(F.concat("header", block).cast("string")).write.option("lineSep", _CRLF * 2).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of a WARC file; ValueError where one is cut or malformed."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split(_CRLF)
        fields = dict(x.split(": ", 1) for x in lines)
        stop = end + 4 + int(fields.get("Content-Length", -1))
        if end < 0 or first != VERSION or data[stop : stop + 4] != b"\r\n\r\n" or stop < end + 4:
            raise ValueError(f"no whole record at byte {at}")
        yield fields, data[end + 4 : stop]
        at = stop + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """fields map<string,string>, block binary: the records of WARC files; a file, of 2 GB at most, is read by one task."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                found = list(parse(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([list(f.items()) for f, _ in found], pa.map_(pa.string(), pa.string())), pa.array([x for _, x in found], pa.binary())], names=["fields", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "fields map<string,string>, block binary")
