"""Content-addressed web archive (operator 6).

``write_archive`` turns pages into WARC/1.1 records and writes two Parquet tables to the
shared folder: ``payloads`` (each distinct payload once, by its SHA-256 digest) and
``headers`` (the exact header block of every record, with the digest of its payload).
``read_archive`` joins them back to the original records byte for byte and verifies every
payload against its digest. Of the records with one payload, that of the largest page id is the
response and the others are revisits of it.

Payloads are grouped by digest, copies in a task first, and written in buckets of the digest, so that the join that rebuilds
records moves no payload. A record with a block (a response) is rebuilt from its header and the payload of its digest; a revisit has no
block, and meets only the length and digest that its payload was found to have.

Defined cases: a null html is an empty payload; a null url is written as an empty target;
rows repeated with one page id and payload give one record each; a record with a null page id is a response whatever has its payload;
of equal page ids the largest is one of them, and all are responses; CR and LF in a url are percent-encoded in its header line; a payload of any length
is one value; extra columns are ignored, whatever their names; an empty table gives empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfold.llm.common import cut, drop_at_end, fresh_path

#: Digits of base 32 as Spark's conv writes them, and as RFC 4648 does.
CONV_DIGITS, RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: 160 bits are four times 40 bits, eight digits each."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV_DIGITS, RFC_DIGITS)


def header_block(page_id: Column, url: Column, kind: Column, digest: Column, n: Column, refers_to: Column) -> Column:
    """The header lines of a record, up to and with the empty line."""
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rid = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    length = F.when(kind == "response", n).otherwise(F.lit(0))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: "), F.coalesce(rid(page_id), F.lit("<urn:page:>")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.coalesce(F.concat(F.lit("\r\nWARC-Refers-To: "), rid(refers_to)), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, table: str | None = None) -> None:
    """Writes ``path``/payloads and ``path``/headers. Payloads under ``min_bytes`` are responses all. ``table``: a name under which the session knows the payloads' buckets."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        "page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).cast("long").alias("payload_bytes")
    )
    keyed = rows.select(
        "page_id", "url", "sha256", "payload_bytes", base32_sha1(F.col("payload")).alias("payload_digest")
    )
    first = keyed.groupBy("sha256").agg(F.max("page_id").alias("response_id"))
    revisit = (F.col("page_id") != F.col("response_id")) & (F.col("payload_bytes") >= min_bytes)
    records = keyed.join(first, "sha256").withColumn("refers_to", F.when(revisit, F.col("response_id")))
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    records.select(
        "page_id", "sha256", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to",
        header_block(F.col("page_id"), F.col("url"), kind, F.col("payload_digest"), F.col("payload_bytes"), F.col("refers_to")).alias("header"),
    ).write.parquet(f"{path}/headers")
    once = rows.groupBy("sha256").agg(F.first("payload").alias("payload"))
    if table:
        # as many buckets as the exchange has partitions: a task writes its own buckets only
        buckets = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        once.write.format("parquet").option("path", f"{path}/payloads").bucketBy(buckets, "sha256").saveAsTable(table)
    else:
        once.write.parquet(f"{path}/payloads")


def verified(payloads: DataFrame) -> DataFrame:
    """Payloads held against their digests; one that doesn't match fails the query."""
    sound = F.sha2(F.col("payload"), 256) == F.col("sha256")
    return payloads.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("corrupt payload "), "sha256")).cast("binary")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records: (page_id, record_type, refers_to, payload_digest, payload_bytes, payload, record), with
    ``record`` the WARC bytes (a revisit has no block) and ``payload`` the verified full payload.
    A payload that doesn't match its digest fails the query."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    payloads = verified(payloads)
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return headers.join(payloads, "sha256").select(
        "page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload",
        F.concat(F.encode(F.col("header"), "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"),
    )


def archive_digest(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archive, rebuilds every record from what is read, and describes it from its own bytes, with ``record_sha256``, the record's digest."""
    own = path is None  # an archive nobody asked to keep
    path, name = path or fresh_path(spark, "warc"), f"warc_payloads_{uuid.uuid4().hex}"
    write_archive(pages, path, table=name)
    if own:
        drop_at_end(spark, path)
    headers, payloads = spark.read.parquet(f"{path}/headers"), verified(spark.table(name))
    end = F.lit(b"\r\n\r\n")
    head = F.encode(F.col("header"), "UTF-8")
    # responses get their block; the payload's bytes stay in their bucket
    whole = headers.where("record_type = 'response'").join(payloads, "sha256").select("page_id", F.concat(head, F.col("payload"), end).alias("record"), F.octet_length(head).alias("skip"))
    block = F.substring(F.col("record"), F.col("skip") + 1, F.octet_length("record") - F.col("skip") - 4)
    responses = whole.select("page_id", "record", F.decode(F.substring(F.col("record"), F.lit(1), F.col("skip")), "UTF-8").alias("header"), F.octet_length(block).cast("long").alias("held_bytes"), base32_sha1(block).alias("held_digest"))
    found = payloads.select("sha256", F.octet_length("payload").cast("long").alias("held_bytes"), base32_sha1(F.col("payload")).alias("held_digest"))
    found = cut(found, "warc-found")  # small, so that a digest that many records have is a join that Spark splits
    revisits = headers.where("record_type = 'revisit'").join(found, "sha256").select("page_id", F.concat(head, end).alias("record"), "header", "held_bytes", "held_digest")
    got = responses.unionByName(revisits).select("page_id", F.sha2("record", 256).alias("record_sha256"), F.split("header", "\r\n").alias("lines"), "held_bytes", "held_digest")
    field = lambda name: F.element_at(
        F.filter("lines", lambda x: x.startswith(name + ": ")), 1
    ).substr(F.lit(len(name) + 3), F.lit(1 << 20))
    refers = F.filter("lines", lambda x: x.startswith("WARC-Refers-To: "))
    return got.select(
        "page_id",
        F.col("held_bytes").alias("payload_bytes"),
        F.col("held_digest").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(F.size(refers) > 0, F.regexp_extract(F.get(refers, F.lit(0)), r"<urn:page:(-?\d+)>", 1).cast("long")).alias("refers_to"),
        (F.concat(F.lit("sha1:"), F.col("held_digest")) == field("WARC-Payload-Digest")).alias("digest_verified"),
        "record_sha256",
    )
