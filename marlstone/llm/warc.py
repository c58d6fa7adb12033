"""A content-addressed web archive: payloads stored once, record headers apart.

An archive is two tables in the shared folder.  ``payloads`` holds the bytes of each
distinct payload once, under its SHA-256.  ``records`` holds for every capture the exact
header block of its WARC record and the digest that leads to its payload.  Joining the
two gives the original records back, byte for byte; digests are worked out anew from the
stored bytes before they are trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import shared_path

# Fixed values of the WARC format and of base32.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"

#: The capture date of records whose table has none.
DATE = "1970-01-01T00:00:00Z"
#: Smallest payload that later captures may refer to, in bytes.
MIN_PAYLOAD = 0


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes in base32: 32 characters of 5 bits, from 8 pieces of 5 hex digits."""
    pieces = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substring(F.sha1(payload), k * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda p, shift: F.substring(F.lit(BASE32), F.shiftright(p, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(*[letter(p, s) for s in (15, 10, 5, 0)])), "")


def _header(fields: list[tuple[str, Column]]) -> Column:
    """A record's header block, with the empty line that ends it; fields that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in fields]
    return F.concat(F.lit(VERSION + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = MIN_PAYLOAD, date: str = DATE) -> None:
    """Writes ``pages`` as an archive below ``path``.

    Of captures with equal payloads of at least ``min_payload`` bytes, the one with the
    largest id is the response that the others revisit; smaller payloads are all
    responses.  A null payload is empty.  A row that repeats the response's id and payload
    is a response too.  A null url leaves its field out, a line end in
    one is percent-encoded, and captures without an id are
    all revisits of the one with the largest id, or responses if none has an id.
    """
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    captures = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    captures = captures.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    # Copies meet in the map-side part of this aggregation, however many they are.
    # A payload that is dropped must also agree with the one that is kept in its length and a second hash.
    alike = F.struct("payload_bytes", F.xxhash64("payload"))
    stored = captures.groupBy("digest").agg(F.first("payload").alias("payload"), F.first("payload_bytes").alias("payload_bytes"), F.max("page_id").alias("owner"), F.min(alike).alias("lo"), F.max(alike).alias("hi"))
    sound = F.when(F.col("lo") == F.col("hi"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("digest"))))
    stored = stored.select(sound.alias("digest"), "payload", "payload_bytes", "owner")
    stored.write.parquet(f"{path}/payloads")
    owners = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "owner")

    meta = captures.select("page_id", "url", "digest", "payload_bytes", base32_sha1(F.col("payload")).alias("sha1")).join(owners.hint("merge"), "digest")
    owned = F.col("owner").isNull() | (F.col("page_id") == F.col("owner")) | (F.col("payload_bytes") < min_payload)
    meta = meta.withColumn("revisit", ~F.coalesce(owned, F.lit(False)))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    header = _header([
        ("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", urn(F.col("page_id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Refers-To", F.when(F.col("revisit"), urn(F.col("owner")))),
        ("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ])
    meta.select("page_id", header.alias("header"), "digest").write.parquet(f"{path}/records")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; fails on bytes that no longer have their digest."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))))
    return stored.withColumn("digest", sound)


def field(header: Column, name: str) -> Column:
    """A field of a header block, null if it is not there."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Original records: page_id, record_type, refers_to, and ``record``, the bytes of a response or revisit.

    ``payload`` is the capture's full payload in either case.
    """
    records = spark.read.parquet(f"{path}/records").join(read_payloads(spark, path).drop("owner").hint("merge"), "digest")
    kind = field(F.col("header"), "WARC-Type")
    block = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("page_id", kind.alias("record_type"), _page(field(F.col("header"), "WARC-Refers-To")).alias("refers_to"), F.concat(F.encode("header", "UTF-8"), block, F.lit((CRLF * 2).encode())).alias("record"), "payload")


def _page(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def archive_report(spark: SparkSession, path: str) -> DataFrame:
    """Per record as read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest come from the stored payload, read once, and must agree with the
    record's own header.  Only these narrow columns are joined to the records.
    """
    payloads = read_payloads(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    records = spark.read.parquet(f"{path}/records")
    header = F.col("header")
    records = records.select(
        _page(field(header, "WARC-Record-ID")).alias("page_id"), field(header, "WARC-Type").alias("record_type"), _page(field(header, "WARC-Refers-To")).alias("refers_to"), field(header, "WARC-Payload-Digest").alias("said"), "digest"
    )
    joined = records.join(payloads.hint("merge"), "digest")
    agreed = F.when(F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("record and payload differ: "), F.col("said"))))
    return joined.select("page_id", "payload_bytes", agreed.alias("payload_digest"), "record_type", "refers_to")


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes an archive to the shared folder and reports what reading it back gives."""
    path = shared_path(pages.sparkSession, "warc")
    write_archive(pages, path, **columns)
    return archive_report(pages.sparkSession, path)
