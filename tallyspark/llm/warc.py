"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; exact record headers are stored apart, each with
the address of its payload. A record is rebuilt by joining the two and putting header, payload and
the closing blank lines together. Both the address and the header's own SHA-1 are checked against
the stored bytes when they are read.

All of it is DataFrame expressions: digests, header text and base32 stay in the JVM. Payload bytes
are shuffled once, to store them once, and once more to meet their headers; the first shuffle's files
are deleted before the second. A payload that very many records share is joined from plain exchanges,
so its headers are split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import materialize
from tallyspark.session import shuffles_removed

CRLF = "\r\n"
# Fixed values of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of SHA-1: the 160 bits in four parts of 40, eight digits each."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE32_HEX, BASE32)


def addressed(df: DataFrame, id_column: str, url_column: str, payload_column: str) -> DataFrame:
    """(id, url, payload, address, bytes, digest): the rows with their payload's SHA-256, length and
    base32 SHA-1. A null payload is empty and a null url an empty target."""
    payload = F.coalesce(F.col(payload_column), F.lit("")).cast("binary")
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(url_column).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    return rows.withColumns(
        {"address": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long"), "digest": sha1_base32(F.col("payload"))}
    )


def header_rows(rows: DataFrame, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One WARC record header per :func:`addressed` row: (id, record_type, refers_to, address, header).

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes that with the largest id is
    the response and the others revisit it; smaller payloads are all responses. A null id is below
    all others, and rows that tie at the largest id are all responses.
    """
    light = rows.drop("payload")
    last = materialize(
        light.where(F.col("bytes") >= min_revisit_bytes)
        .groupBy("address")
        .agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("address").alias("last_address"), "last"),
        "warc-last",
    )
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    return light.join(last, F.col("address") == F.col("last_address"), "left").select(
        "id",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("last")).alias("refers_to"),
        "address",
        _header(revisit, date).alias("header"),
    )


def payload_rows(rows: DataFrame) -> DataFrame:
    """(address, payload), one row per distinct payload: whichever copy is kept, the bytes are the same."""
    return rows.groupBy("address").agg(F.any_value("payload").alias("payload"))


def _record_id(value: Column) -> Column:
    """A UUID-shaped name that depends on the row's id only."""
    h = F.sha2(F.concat(F.lit("record:"), F.coalesce(value.cast("string"), F.lit("null"))), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _header(revisit: Column, date: str) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    # A line break in a url would end its header field.
    target = F.regexp_replace("url", r"[\r\n]", "")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("last"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(rows: DataFrame, path: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Store :func:`addressed` rows as two tables, headers and payloads, and return them as read
    back. ``path`` is a folder for both; left out, they go below the shared folder. ``options`` are
    those of :func:`header_rows`. What was shuffled to write them is deleted."""
    with shuffles_removed(rows.sparkSession):
        headers, payloads = header_rows(rows, **options), payload_rows(rows)
        if path is None:
            return materialize(headers, "warc-headers"), materialize(payloads, "warc-payloads")
        for name, part in (("headers", headers), ("payloads", payloads)):
            part.write.option("compression", "zstd").parquet(f"{path}/{name}")
    return read_archive(rows.sparkSession, path)


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")


def verified(payloads: DataFrame) -> DataFrame:
    """The payloads, failing on the first whose bytes do not hash to their address."""
    ok = F.sha2("payload", 256) == F.col("address")
    return payloads.withColumn("payload", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its address "), F.col("address"))).cast("binary")))


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(id, record_type, refers_to, payload, record): the exact WARC record bytes of every header.

    A revisit record has an empty block; its ``payload`` is that of the response it refers to.
    """
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    end = F.lit(CRLF + CRLF).cast("binary")
    return headers.join(verified(payloads), "address").select(
        "id", "record_type", "refers_to", "payload", F.concat(F.col("header").cast("binary"), block, end).alias("record")
    )


def parse_header(header: Column, name: str) -> Column:
    """The value of one field of a header block; null if it has no such field."""
    value = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(header.rlike(rf"(?im)^{name}:"), value)


def record_facts(records: DataFrame) -> DataFrame:
    """(id, record_type, refers_to, payload_bytes, payload_digest) as parsed from :func:`reconstruct`
    records: the record is cut at its first blank line, its block must have the length its header states
    and close with two line ends, and the payload must have the digest its header states. A record that
    does not agree with itself fails the job."""
    # field values are ASCII but for urls, and a blank line ends the header whatever the url holds
    head = F.substring_index(F.decode("record", "ISO-8859-1"), CRLF + CRLF, 1)
    cut = records.withColumn("head", head).withColumn("at", F.length("head") + len(CRLF + CRLF))
    size = parse_header(F.col("head"), "Content-Length").cast("long")
    block = F.col("record").substr(F.col("at") + 1, size.cast("int"))
    whole = (F.octet_length("record") == F.col("at") + size + len(CRLF + CRLF)) & (F.col("record").substr(F.length("record") - 3, F.lit(4)) == F.lit(CRLF + CRLF).cast("binary"))
    kind = parse_header(F.col("head"), "WARC-Type")
    payload = F.when(kind == "revisit", F.col("payload")).otherwise(block)
    digest = sha1_base32(payload)
    said = parse_header(F.col("head"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)
    named = F.coalesce(parse_header(F.col("head"), "WARC-Refers-To") == _record_id(F.col("refers_to")), kind != "revisit")
    agrees = F.coalesce(whole & said & named & (kind == F.col("record_type")), F.lit(False))
    return cut.select(
        "id",
        F.when(agrees, kind).otherwise(F.raise_error(F.concat(F.lit("record does not agree with itself: "), F.col("head"))).cast("string")).alias("record_type"),
        F.when(kind == "revisit", F.col("refers_to")).alias("refers_to"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
    )


def archive_pages(df: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``page_id``, ``url``, ``html`` rows to an archive, read it back, rebuild every record by
    the join of headers and payloads, and describe it: page_id, payload_bytes, payload_digest,
    record_type, refers_to. Null html is an empty payload, a null id is never referred to unless all ids
    of its payload are null; repeated rows are records of their own; other columns are ignored."""
    rows = addressed(df, "page_id", "url", "html")
    headers, payloads = write_archive(rows, min_revisit_bytes=min_revisit_bytes)
    out = record_facts(reconstruct(headers, payloads))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
