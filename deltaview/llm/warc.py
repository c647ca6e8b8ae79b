"""Content-addressed WARC archive.

``write_archive`` stores each payload's bytes once, under its SHA-256, and every record's exact
header block in a separate table. A payload that several records share and that is long enough is
held by one response record (the largest id); the others are revisit records that name it and have no
block of their own (identical-payload-digest profile). ``read_archive`` joins headers with payloads,
checks every stored payload against its digest and gives back whole records beside the payload that
each record stands for; ``parse_records`` reads the fields from the header bytes.

Defined results: null payloads count as empty; a null id or url becomes an empty header field; line
ends in a url are written as %0D and %0A; without a date column every record has the date NO_DATE; rows
that repeat id and payload get equal records (both are the response, or both revisit); an empty
table gives an empty archive; other columns are ignored. A stored payload that does not match its
digest makes the read fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaview.llm._store import Scratch

MIN_SHARED_BYTES = 1000
CRLF = "\r\n"
NO_DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The end of a header is looked for in so many bytes first, and in the whole record only if it is not there.
HEADER_BYTES = 8192


def record_uri(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"urn:{kind}:"), F.coalesce(key.cast("string"), F.lit("")))


def _header(fields: list[tuple[str, Column | None]]) -> Column:
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit(CRLF)).cast("binary")


def write_archive(
    pages: DataFrame,
    scratch: Scratch,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_shared_bytes: int = MIN_SHARED_BYTES,
    date_col: str | None = None,
) -> None:
    """Write the tables ``payloads`` (digest, body) and ``headers`` (digest, header, revisit). date_col: a timestamp."""
    date = F.lit(NO_DATE) if date_col is None else F.coalesce(F.date_format(F.to_utc_timestamp(date_col, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(NO_DATE))
    rows = pages.select(F.col(id_col).alias("id"), date.alias("date"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("body", 256)))
    # one row per payload and map task leaves for the shuffle
    scratch.save(rows.groupBy("digest").agg(F.first("body").alias("body")), "payloads")
    small = rows.select("id", "date", "url", "digest", F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("size"))
    groups = small.groupBy("digest").agg(F.max("id").alias("holder"))
    keyed = small.join(groups, "digest").withColumn("revisit", (F.col("size") >= min_shared_bytes) & (F.col("id") != F.col("holder")))
    revisit = F.coalesce(F.col("revisit"), F.lit(False))
    header = _header(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", F.concat(F.lit("<"), record_uri("page", F.col("id")), F.lit(">"))),
            ("WARC-Date", F.col("date")),
            ("WARC-Target-URI", F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            ("WARC-Block-Digest", F.when(~revisit, F.concat(F.lit("sha256:"), F.lower(F.hex("digest"))))),
            ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), record_uri("page", F.col("holder")), F.lit(">")))),
            ("Content-Type", F.lit("text/html; charset=utf-8")),
            ("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        ]
    )
    scratch.save(keyed.select("digest", header.alias("header"), revisit.alias("revisit")), "headers")


def read_archive(scratch: Scratch) -> DataFrame:
    """Records: header, body (the payload that a record holds or names), record (header, block and two line ends; a revisit has no block)."""
    spark: SparkSession = scratch.spark
    headers = spark.read.parquet(scratch.path("headers"))
    payloads = spark.read.parquet(scratch.path("payloads"))
    good = F.unhex(F.sha2("body", 256)) == F.col("digest")
    checked = payloads.withColumn("body", F.when(good, F.col("body")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary")))
    joined = headers.join(checked, "digest")
    block = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("body"))
    return joined.select("digest", "header", "body", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def header_field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header.cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def parse_records(records: DataFrame) -> DataFrame:
    """Fields of whole records (columns ``record`` and ``body``). A block is cut out by Content-Length; a revisit's payload is the one it was joined with."""
    end = F.expr(f"locate('\\r\\n\\r\\n', decode(substring(record, 1, {HEADER_BYTES}), 'ISO-8859-1'))")
    far = F.expr("locate('\\r\\n\\r\\n', decode(record, 'ISO-8859-1'))")
    cut = records.select("record", "body", F.when(end > 0, end).otherwise(far).alias("at")).withColumn("head", F.expr("substring(record, 1, at + 3)"))
    block = F.expr("substring(record, at + 4, CAST(regexp_extract(CAST(head AS STRING), 'Content-Length: ([0-9]+)', 1) AS INT))")
    body = F.when(header_field(F.col("head"), "WARC-Type") == "revisit", F.col("body")).otherwise(block)
    out = cut.select("head", body.alias("body")).withColumn("size", F.octet_length("body").cast("long"))
    page = lambda name: F.regexp_extract(header_field(F.col("head"), name), r"^<urn:page:(.*)>$", 1)
    return out.select(
        F.expr("try_cast(regexp_extract(cast(head as string), '(?m)^WARC-Record-ID: <urn:page:([^>]*)>', 1) as bigint)").alias("page_id"),
        header_field(F.col("head"), "WARC-Target-URI").alias("url"),
        header_field(F.col("head"), "WARC-Type").alias("record_type"),
        F.when(header_field(F.col("head"), "WARC-Refers-To").isNotNull(), page("WARC-Refers-To").cast("long")).alias("refers_to"),
        header_field(F.col("head"), "WARC-Payload-Digest").alias("declared"),
        "size",
        "body",
    )


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archive, read it back and describe each record from its own bytes."""
    scratch = Scratch(pages.sparkSession, "warc")
    write_archive(pages, scratch, id_col, url_col, payload_col)
    return parse_records(read_archive(scratch))
