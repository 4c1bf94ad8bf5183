"""A content-addressed WARC archive.

Payload bytes are stored once per SHA-256 digest, record headers exactly and apart from them, and
records are put together again by a join.  Of equal payloads the record with the largest identifier
is the response; the others are revisits that name it.  A response's block is an HTTP head and the
payload, a revisit's block the HTTP head alone.

Rows with one digest must agree in length and in a second hash, else writing ends with an error; on reading
every payload is digested again.  A record's identifier is a UUID of its row's identifier, URL and
digest, and of a number if such rows are repeated, so it is found again however often a task runs.

A null payload is empty.  Rows with equal identifiers and payloads are each written; those with the
largest identifier are all responses, and revisits name the one with the largest URL.  A null identifier
loses to any other.  Line breaks in a URL are percent-encoded in its header.  Payloads of any length are
written whole.  An empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # of base32
_BREAK = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of bytes: 32 characters for 160 bits, four for five hex digits."""
    digits, out = F.sha1(payload), []
    for i in range(8):
        value = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_BREAK))


def _record_id(key: Column, url: Column, digest: Column, number: Column) -> Column:
    hexes = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), number.cast("string"), digest, F.coalesce(url, F.lit(""))).cast("binary"))
    at = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(hexes, i, n) for i, n in at]), F.lit(">"))


def write_archive(pages: DataFrame, path: str, payload: str = "html", url: str = "url", key: str = "page_id", least: int = 0, date: str | None = None) -> None:
    """Write ``path``/payloads and ``path``/records; payloads under ``least`` bytes are never revisited.

    ``date`` is the records' WARC-Date, the time of writing if it is not given.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    check = F.struct(F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("hash"))
    found = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.max(F.struct("id", "url")).alias("response"), F.min(check).alias("lo"), F.max(check).alias("hi"))
    wrong = F.raise_error(F.concat(F.lit("different payloads have the digest "), F.col("digest"))).cast("binary")
    one = F.when(F.col("lo") == F.col("hi"), F.col("payload")).otherwise(wrong)
    found.select("digest", one.alias("payload"), "response", F.col("lo.size").alias("size"), base32_sha1(F.col("payload")).alias("sha1")).write.parquet(f"{path}/payloads")
    known = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "response", "size", "sha1")
    # Rows that agree in everything are counted, then told apart by number.
    counted = rows.groupBy("id", "url", "digest").agg(F.count(F.lit(1)).alias("n")).select("id", "url", "digest", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))
    heads = counted.join(known, "digest")
    first = F.col("id").eqNullSafe(F.col("response.id")) | (F.col("size") < least)
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\\r", "%0D"), "\\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_BREAK}Content-Type: text/html; charset=utf-8{_BREAK}Content-Length: "), F.col("size").cast("string"), F.lit(_BREAK * 2))
    refers = F.concat(
        _line("WARC-Refers-To", _record_id(F.col("response.id"), F.col("response.url"), F.col("digest"), F.lit(1))),
        _line("WARC-Refers-To-Page", F.col("response.id").cast("string")),
        _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    )
    header = F.concat(
        F.lit(f"WARC/1.1{_BREAK}"),
        _line("WARC-Type", F.when(first, F.lit("response")).otherwise(F.lit("revisit"))),
        _line("WARC-Record-ID", _record_id(F.col("id"), F.col("url"), F.col("digest"), F.col("number"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Page", F.coalesce(F.col("id").cast("string"), F.lit(""))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(first, F.lit("")).otherwise(refers),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.length("http") + F.when(first, F.col("size")).otherwise(F.lit(0))).cast("string")),
        F.lit(_BREAK),
    )
    heads.withColumn("http", http).select(header.alias("header"), "http", "digest").write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, record): every record; ``payload`` is the full one, ``record`` the exact bytes.

    A payload whose digest is not its address ends the read with an error.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest"))).cast("binary")
    sound = payloads.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong).alias("payload"))
    rows = spark.read.parquet(f"{path}/records").join(sound, "digest")
    body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.encode(F.concat("header", "http"), "UTF-8"), body, F.lit(f"{_BREAK}{_BREAK}".encode()))
    return rows.select("header", "payload", record.alias("record"))


def field(name: str, header: str = "header") -> Column:
    """A header field's value; null if the record has none."""
    value = F.regexp_extract(header, f"\\r\\n{name}: ([^\\r]*)", 1)
    return F.when(F.col(header).contains(f"{_BREAK}{name}: "), value)


def digest_of(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records read back."""

    def number(name: str) -> Column:
        return field(name).try_cast("bigint")

    return archive.select(
        number("WARC-Page").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To-Page").alias("refers_to"),
    )
