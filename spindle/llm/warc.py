r"""A content-addressed WARC archive: payload bytes once by strong digest, exact record headers apart.

`write_archive` makes two Parquet tables: `headers` (one row a record: its exact header bytes and the
payload's SHA-256) and `payloads` (one row a digest: the bytes). `read_archive` joins them and gives back whole
records; every payload is hashed again as it is read and a mismatch fails the job. Of records with equal
payloads of at least `min_revisit` bytes the one with the largest id is the `response`; the others are
`revisit` records that name it. Smaller ones are all responses.

Nulls and ties: a null html is an empty payload. A null id sorts below all others and gets a
record id made of the payload's digest. Rows that repeat the largest id and its payload are all responses. A null url gives an empty
WARC-Target-URI. An empty table gives an empty archive. Extra columns are not archived.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, shared_dir, shuffles_freed, table

#: DATE: WARC-Date of all records, since pages have none.
MIN_REVISIT, DATE = 1000, "1970-01-01T00:00:00Z"
CRLF = "\r\n"


def _header(kind: Column, record_id: Column, url: Column, digest: Column, size: Column, refers: Column) -> Column:
    """Header block of a record as it stands in a WARC file, with the blank line that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(record_id.cast("string"), F.concat(F.lit("null:"), digest)), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.when(refers.isNull(), F.lit("")).otherwise(
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">"))),
            )
        ),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, key: str = "page_id", min_revisit: int = MIN_REVISIT) -> None:
    """Writes `path`/headers and `path`/payloads. key, `url` and `html` are read.

    What is shuffled to find equal payloads is a digest and an id a row, summed on the map side, so a payload
    that a third of all rows share is one row from each task. Payload bytes are shuffled once, to meet the largest
    id of their digest: those of a frequent payload spread over (digest, id) and only one of them is kept."""
    require(pages, key, "url", "html")
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("id"), "url", body.alias("body")).select(
        "id", "url", "body", F.sha2("body", 256).alias("sha256"), F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("size")
    )
    heads = rows.drop("body")
    first = heads.groupBy("sha256").agg(F.max("id").alias("keeper"))
    both = heads.join(first, "sha256")
    revisit = (F.col("size") >= min_revisit) & ~F.col("id").eqNullSafe(F.col("keeper"))
    both = both.withColumn("kind", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")))
    both.select(
        F.col("id"),
        "sha256",
        F.encode(
            _header(F.col("kind"), F.col("id"), F.col("url"), F.col("sha1"), F.col("size"), F.when(revisit, F.col("keeper"))), "UTF-8"
        ).alias("header"),
    ).write.option("compression", "zstd").parquet(f"{path}/headers")
    # (digest, id) spreads the rows of a frequent payload before one of them is kept
    lowest = F.lit(-(1 << 63))
    keepers = first.select("sha256", F.coalesce("keeper", lowest).alias("keeper"))
    kept = rows.select("sha256", F.coalesce("id", lowest).alias("keeper"), "body").join(keepers, ["sha256", "keeper"], "left_semi")
    once = kept.groupBy("sha256", "keeper").agg(F.first("body").alias("body")).drop("keeper")  # no further shuffle of payloads
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Whole records: id, header, payload (bytes of the full payload, of revisits too), record (the bytes that a
    WARC file holds: header, the payload unless it is a revisit, and two line ends)."""
    heads = spark.read.parquet(f"{path}/headers")
    bodies = spark.read.parquet(f"{path}/payloads")
    ok = F.sha2("body", 256) == F.col("sha256")
    bad = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("sha256"))).cast("binary")
    checked = bodies.withColumn("payload", F.when(ok, F.col("body")).otherwise(bad)).drop("body")
    records = heads.join(checked, "sha256")
    held = F.when(header_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.withColumn("record", F.concat(F.col("header"), held, F.lit(b"\r\n\r\n"))).drop("sha256")


def header_field(name: str) -> Column:
    """A field of the column `header`, null where it is absent."""
    text = F.decode("header", "UTF-8")
    return F.nullif(F.regexp_extract(text, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))


def page_of(field: Column) -> Column:
    return F.nullif(F.regexp_extract(field, r"^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        write_archive(table(spark, sf_dir, "pages"), path)
    records = read_archive(spark, path)
    return records.select(
        page_of(header_field("WARC-Record-ID")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"),
        page_of(header_field("WARC-Refers-To")).alias("refers_to"),
    )


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
    max(page_id) OVER (PARTITION BY body) AS keeper
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM d
"""
