"""A content-addressed WARC archive: payloads once by digest, record headers apart, records by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.shared import new_path

#: Smaller payloads are stored with every record that has them named as response.
REVISIT_BYTES = 100
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(kind: str) -> F.Column:
    """Exact header bytes of a record, up to and with the empty line; CRLF ends every line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    number = F.col("page_id").cast("string")
    common = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(number, F.lit("none")), F.lit(">"))),
        line("WARC-Target-URI", F.translate(F.coalesce("url", F.lit("")), "\r\n", "")),
        F.lit(f"WARC-Date: {_DATE}\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("n_bytes").cast("string")),
    ]
    if kind == "revisit":
        common += [F.lit(f"WARC-Profile: {_PROFILE}\r\n"), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">"))), F.lit("Content-Length: 0\r\n")]
    else:
        common += [F.lit("Content-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("n_bytes").cast("string"))]
    return F.concat(*common, F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes `path`/payloads (digest, payload: each different payload once) and `path`/records (digest, header).

    A page is one record. Among pages with equal payloads of at least REVISIT_BYTES the one with the smallest
    page_id is the response and the others are revisits; smaller payloads are responses throughout. A null html is an
    empty payload; a null url an empty one; rows with null page_ids are responses of their own; repeated rows give
    repeated records, those with the smallest id being responses all. Other columns are ignored; an empty table gives an empty archive.
    """
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("bigint"))
    # digests and ids only; a partial minimum per task, so a payload that a third of the pages share is one row a task
    first = base.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    index = base.select("page_id", "url", "digest", "n_bytes").join(first, "digest")
    revisit = (F.col("n_bytes") >= REVISIT_BYTES) & (F.col("page_id") > F.col("first_id"))
    index.select("digest", F.encode(F.when(revisit, _header("revisit")).otherwise(_header("response")), "utf-8").alias("header")).write.parquet(f"{path}/records")
    # any of the equal payloads will do; the partial step leaves one a task
    base.groupBy("digest").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, record): every original record, put together by a join on the digest.

    `record` is the bytes of the WARC record: header, block and the two empty lines; a revisit has no block, while
    `payload` is what it revisits.
    """
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    block = F.when(F.decode("header", "utf-8").contains("\r\nWARC-Type: revisit\r\n"), F.encode(F.lit(""), "utf-8")).otherwise(F.col("payload"))
    return records.join(payloads, "digest").select("header", "payload", F.concat("header", block, F.encode(F.lit("\r\n\r\n"), "utf-8")).alias("record"))


def parsed(records: DataFrame) -> DataFrame:
    """What the records' own bytes say, with `verified`: lengths and digests recomputed from the stored payload agree."""
    head = F.split_part(F.decode("header", "utf-8"), F.lit("\r\n\r\n"), F.lit(1))
    field = lambda name, pattern: F.nullif(F.regexp_extract(head, rf"\r\n{name}: {pattern}", 1), F.lit(""))
    return records.select(
        field("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("bigint").alias("page_id"),
        field("WARC-Payload-Length", r"(\d+)").cast("bigint").alias("payload_bytes"),
        field("WARC-Payload-Digest", r"sha256:([0-9a-f]{64})").alias("payload_digest"),
        field("WARC-Type", r"(\w+)").alias("record_type"),
        field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("bigint").alias("refers_to"),
        field("Content-Length", r"(\d+)").cast("bigint").alias("content_length"),
        F.sha2("payload", 256).alias("found_digest"),
        F.octet_length("payload").cast("bigint").alias("found_bytes"),
        (F.octet_length("record") - F.octet_length("header") - 4).cast("bigint").alias("block_bytes"),
    ).withColumn("verified", F.expr("found_digest = payload_digest and found_bytes = payload_bytes and block_bytes = content_length"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = parsed(read_records(spark, path))
    checked = F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")))
    return found.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


OP6_SQL = f"""
WITH base AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
first AS (SELECT payload_digest, min(page_id) AS first_id FROM base GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id > first_id THEN first_id END AS refers_to
FROM base JOIN first USING (payload_digest)
"""
