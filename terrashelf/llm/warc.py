"""A content-addressed web archive: every payload once under its strong digest, exact record headers beside it.

``write_archive`` writes two tables below a folder. ``payloads`` holds each distinct payload once under its SHA-256
(pre-aggregated before the shuffle, so a group of copies of any size costs one copy a task). ``headers`` holds, for every
record, the exact bytes of its WARC 1.1 header block and the digest of its payload. ``records`` joins both into the full
original records, ``read_index`` takes those apart again and fails on one that is not what it says of itself, and
``export_warc`` writes them as .warc files.

Of records with equal payloads of at least ``least_bytes``, the one with the largest page_id is the response and the
others are revisits that refer to it; smaller ones are all responses.

Cases: a null payload is empty. A null url is an empty target. Rows that repeat a page_id each get a record; of equal ones
only the record's number tells them apart, and exactly one is the response. Null identifiers come last. Control signs in a
url are percent-encoded, so a header is always one line. An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.llm.common import table
from terrashelf.session import cut, scratch_path

#: Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as 32 signs of upper-case base32: five hex digits make four of them."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _DIGITS32, _BASE32)


def _uri(url: Column) -> Column:
    plain = coded = F.coalesce(url, F.lit(""))
    for code in [*range(0x21), 0x7F]:
        coded = F.replace(coded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(F.rlike(plain, F.lit(r"[\x00-\x20\x7F]")), coded).otherwise(plain)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def header_block(page_id, url, size, digest, revisit, refers_to) -> Column:
    """The header lines of a record up to and with the empty line, then those of the HTTP response inside it.

    A revisit's block is the HTTP head alone; that of a response is followed by the payload.
    """
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(page_id)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), _uri(url)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(refers_to))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.lit(len(HTTP)) + F.when(revisit, 0).otherwise(size)).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF + HTTP))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write the archive of ``pages(page_id, url, html)`` below ``path``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload")
    ).withColumn("address", F.sha2("payload", 256))
    stored = rows.groupBy("address").agg(F.max("payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")

    facts = cut(rows.select(
        "page_id", "url", "address", F.octet_length("payload").cast("long").alias("size"),
        base32_sha1(F.col("payload")).alias("digest"), F.monotonically_increasing_id().alias("number"),
    ))
    rank = F.struct(F.col("page_id").isNotNull(), "page_id", "number")
    first = facts.where(F.col("size") >= least_bytes).groupBy("address").agg(
        F.max(rank).alias("top"), F.count("*").alias("n")
    )
    first = first.where("n > 1").select("address", F.col("top.page_id").alias("of"), F.col("top.number").alias("of_number"))
    joined = facts.join(first, "address", "left")
    revisit = F.col("of_number").isNotNull() & (F.col("number") != F.col("of_number"))
    header = header_block(F.col("page_id"), F.col("url"), F.col("size"), F.col("digest"), revisit, F.col("of"))
    joined.select("number", "address", F.encode(header, "UTF-8").alias("header")).write.option(
        "compression", "zstd").parquet(f"{path}/headers")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads, each checked against its address."""
    stored = spark.read.schema("address string, payload string").parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("address")
    wrong = F.raise_error(F.concat(F.lit("payload is not what its address says: "), "address"))
    return stored.select("address", F.when(right, F.col("payload")).otherwise(wrong.cast("string")).alias("payload"))


def _headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("number long, address string, header binary").parquet(f"{path}/headers")


def _record(head: Column, payload: Column) -> Column:
    """A record's text: its header block, its payload unless it is a revisit, and two line ends."""
    revisit = F.split(head, CRLF)[1] == "WARC-Type: revisit"
    return F.concat(head, F.when(revisit, "").otherwise(payload), F.lit(CRLF + CRLF))


def records(spark: SparkSession, path: str) -> DataFrame:
    """number, record: the full bytes of every record, closed by two line ends; a revisit has no payload."""
    text = _record(F.decode("header", "UTF-8"), F.col("payload"))
    return _headers(spark, path).join(_payloads(spark, path), "address").select(
        "number", F.encode(text, "UTF-8").alias("record")
    )


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """header, payload of every record, revisits with the payload they refer to."""
    return _headers(spark, path).join(_payloads(spark, path), "address").select("number", "header", "payload")


def export_warc(spark: SparkSession, path: str, target: str) -> None:
    """Write the records as .warc text: each row is a record, and the line end is the one that closes records."""
    head = F.decode("header", "UTF-8")
    revisit = F.split(head, CRLF)[1] == "WARC-Type: revisit"
    whole = _headers(spark, path).join(_payloads(spark, path), "address")
    whole.select(F.concat(head, F.when(revisit, "").otherwise(F.col("payload")))).write.option(
        "lineSep", CRLF + CRLF).text(target)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What the records say, read from their rebuilt bytes: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Every record is put together and taken apart again: its fields come from its own lines, its body must be as long as it
    says, and size and digest are computed from the payload, which a revisit takes from the record it refers to.
    """
    whole = _headers(spark, path).join(_payloads(spark, path), "address")
    record = whole.select("address", "payload", _record(F.decode("header", "UTF-8"), F.col("payload")).alias("record"))
    ends = F.instr("record", CRLF + CRLF)
    parted = record.select(
        "address", "payload", F.substr("record", F.lit(1), ends - 1).alias("head"),
        F.substr("record", ends + 4, F.length("record") - ends - 7).alias("body"))
    field = lambda name: F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1)
    number = lambda name: F.nullif(F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
    read = parted.select(
        "address", number("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Payload-Digest").alias("said"), field("Content-Length").cast("long").alias("length"), "body",
        F.when(field("WARC-Type") == "revisit", F.col("payload")).otherwise(
            F.substr("body", F.lit(len(HTTP) + 1))).alias("payload"),
    )
    measured = read.select(
        "*", F.octet_length("body").alias("found"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest")).drop("body", "payload")
    right = (F.col("said") == F.concat(F.lit("sha1:"), "payload_digest")) & (F.col("length") == F.col("found"))
    wrong = F.raise_error(F.concat(F.lit("header and payload differ: "), "address")).cast("string")
    return measured.select(
        "page_id", "payload_bytes", F.when(right, F.col("payload_digest")).otherwise(wrong).alias("payload_digest"),
        "record_type", "refers_to", "target_uri",
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_index(spark, path).drop("target_uri")


_SQL32 = " || ".join(
    f"substr('{_BASE32}', 1 + ((x >> {shift}) & 31), 1)" for shift in (15, 10, 5, 0)
)
SQL = f"""
WITH rows AS (
    SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS address FROM pages),
marked AS (
    SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h,
           row_number() OVER (PARTITION BY address ORDER BY page_id DESC NULLS LAST) AS place,
           max(page_id) OVER (PARTITION BY address) AS top
    FROM rows)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(
           list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(1 + 5 * i AS INTEGER), 5) AS INTEGER)),
           lambda x: {_SQL32}), '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN top END AS refers_to
FROM marked"""

QUERIES = {"op3_warc": op3_warc}
ORACLE = {"op3_warc": SQL}
