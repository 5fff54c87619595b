"""Content-addressed WARC archive.

An archive is two tables in one folder.  ``payloads`` holds each distinct
payload once under its SHA-256; ``records`` holds the exact header bytes of
every record with that digest.  The original records, byte for byte, are the
header, the payload of the digest (none for a revisit) and the closing blank
lines, and come back through one join.  Reading computes the digest of every
stored payload again and fails on a difference.  It also counts length and
SHA-1 once per stored payload, before that join, so a result that needs no
payload sends none.

Records with equal payloads of at least ``min_revisit_bytes`` are written once
as ``response``, that with the smallest page_id, and as ``revisit`` otherwise.
Which page that is comes from digests alone, so large groups of copies send
one small row per task, and only the chosen pages' payloads are stored.

Defined results: null html is the empty payload; a null url is written as
``about:blank``; rows with a null page_id are records too, after all others
(no id can name one, so equal payloads of null ids only are all responses);
of rows repeating a page_id each is a record, and those of the smallest
page_id of a payload are all responses; an empty table gives an empty archive;
other columns are ignored.  Payloads of any length are kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
_B32 = ("0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of ``payload`` in bare upper-case base32 (32 digits)."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.lower(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), *_B32)


def _header_lines(record: dict[str, Column | str]) -> Column:
    parts = [F.lit("WARC/1.1" + CRLF)]
    for name, value in record.items():
        line = F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(CRLF))
        parts.append(F.coalesce(line, F.lit("")))
    return F.concat(*parts, F.lit(CRLF))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    min_revisit_bytes: int = 0,
) -> None:
    """Writes one record per row of ``pages`` to the folder ``path``."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    digests = rows.select(
        "page_id",
        "url",
        F.sha2("payload", 256).alias("digest"),
        base32_sha1(F.col("payload")).alias("sha1"),
        F.octet_length("payload").cast("long").alias("bytes"),
    )
    shared = F.when(F.col("bytes") >= min_revisit_bytes, F.col("digest"))
    firsts = digests.where(shared.isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    marked = digests.join(firsts, "digest", "left").withColumn(
        "first_id", F.when(F.col("bytes") >= min_revisit_bytes, F.col("first_id"))
    )
    revisit = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("page_id").isNull() & F.col("first_id").isNotNull())
    name = lambda i: F.concat(F.lit("<urn:x-page:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(">"))
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
    header = _header_lines({
        "WARC-Type": F.when(revisit, "revisit").otherwise("response"),
        "WARC-Record-ID": name(F.col("page_id")),
        "WARC-Target-URI": F.regexp_replace("url", "[\\r\\n]", ""),
        "WARC-Date": date,
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("sha1")),
        "WARC-Payload-Length": F.col("bytes").cast("string"),
        "WARC-Refers-To": F.when(revisit, name(F.col("first_id"))),
        "WARC-Profile": F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": (F.when(revisit, 0).otherwise(F.col("bytes")) + len(http)).cast("string"),
    })
    marked.select(
        "page_id", "digest", F.concat(header, F.lit(http)).cast("binary").alias("header"), (~revisit).alias("has_payload")
    ).write.parquet(f"{path}/records")
    # one row per digest: payloads of equal digest meet in partial aggregates before they are sent
    rows.groupBy(F.sha2("payload", 256).alias("digest")).agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload, has_payload, found_bytes, found_digest): every record, with the payload its digest names.

    ``found_bytes`` and ``found_digest`` (base32 SHA-1) are counted from that payload.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    payloads = payloads.select("digest", F.when(
        F.sha2("payload", 256) == F.col("digest"), F.col("payload")
    ).otherwise(F.raise_error(F.lit("a stored payload does not have its digest"))).alias("payload"))
    payloads = payloads.select(
        "digest",
        "payload",
        F.octet_length("payload").cast("long").alias("found_bytes"),
        base32_sha1(F.col("payload")).alias("found_digest"),
    )
    return spark.read.parquet(f"{path}/records").join(payloads, "digest").select("page_id", "header", "payload", "has_payload", "found_bytes", "found_digest")


def record_bytes(archive: DataFrame) -> DataFrame:
    """(page_id, record): the original records, byte for byte."""
    end = F.lit(2 * CRLF).cast("binary")
    body = F.when(F.col("has_payload"), F.col("payload")).otherwise(F.lit(b""))
    return archive.select("page_id", F.concat("header", body, end).alias("record"))


def parse_records(archive: DataFrame) -> DataFrame:
    """Header fields of each record beside its payload and what was counted from it."""
    head = F.decode("header", "UTF-8")
    field = lambda k, v: F.nullif(F.regexp_extract(head, f"\\r\\n{k}: {v}\\r\\n", 1), F.lit(""))
    number = lambda k: F.expr("cast(null as bigint)") if k is None else field(k, "(\\d+)").cast("long")
    return archive.select(
        field("WARC-Record-ID", "<urn:x-page:(-?\\d+)>").cast("long").alias("page_id"),
        field("WARC-Type", "(\\w+)").alias("record_type"),
        field("WARC-Target-URI", "([^\\r]*)").alias("url"),
        field("WARC-Payload-Digest", "sha1:(\\w+)").alias("payload_digest"),
        number("WARC-Payload-Length").alias("payload_bytes"),
        field("WARC-Refers-To", "<urn:x-page:(-?\\d+)>").cast("long").alias("refers_to"),
        "payload",
        "found_bytes",
        "found_digest",
    )


def checked(records: DataFrame) -> DataFrame:
    """Parsed ``records`` with length and digest as counted from the payload read.

    Fails where a header names others, so a lazy result reads every payload.
    """
    same = lambda found, told, what: F.when(F.col(found).eqNullSafe(F.col(told)), F.col(found)).otherwise(
        F.raise_error(F.lit(f"a payload does not have the {what} of its header")))
    return records.withColumns({
        "payload_bytes": same("found_bytes", "payload_bytes", "length").cast("long"),
        "payload_digest": same("found_digest", "payload_digest", "digest").cast("string"),
    }).drop("found_bytes", "found_digest")
