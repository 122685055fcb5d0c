"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart.

Payloads are stored in one bucketed table by their SHA-256, one row per distinct content; record
headers, byte for byte as a WARC file has them, in another. Reading joins the two on the digest within
equal buckets, so payload bytes are shuffled once, when written, and never again; each payload is
checked against its digest as it is read. A payload that many pages share is one row: the page with
the smallest id is its response, the others are revisits without a body of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm.common import base32_sha1, lookup_join, pin, table

CRLF = "\r\n"


def _fields(payload: Column) -> dict[str, Column]:
    return {"sha256": F.sha2(payload, 256), "sha1": base32_sha1(F.sha1(payload)), "bytes": F.length(payload).cast("long")}


def _header(record_type: Column, page: Column, url: Column, sha1: Column, size: Column, refers: Column) -> Column:
    """WARC/1.1 record header up to its blank line; line breaks in a url are percent-encoded. The block's
    length is that of the payload for a response, 0 for a revisit, which tells the full payload's length apart."""
    target = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), record_type),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page.cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(record_type == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers.cast("string"), F.lit(">"))),
        F.when(record_type == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Length: "), size.cast("string")),
        F.concat(F.lit("Content-Length: "), F.when(record_type == "revisit", F.lit(0)).otherwise(size).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write the archive; gives the name of the payload table and the pinned record table (header, sha256, record_type, first_of_payload).

    Null bodies are empty payloads. Payloads shorter than least_bytes are all responses. Rows with a null
    id sort last among those of a payload; of rows repeated with one id the first is the response. An empty
    table writes an empty archive. Other columns of pages are not read.
    """
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    raw = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), body.alias("payload"))
    scan = raw.withColumns(_fields(F.col("payload")))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"warc_payloads_{uuid.uuid4().hex}"
    stored = scan.select("sha256", "payload").groupBy("sha256").agg(F.first("payload").alias("payload"), F.count("*").alias("pages"))
    (stored.write.option("compression", "zstd").bucketBy(buckets, "sha256").sortBy("sha256").saveAsTable(name))

    heads = pin(scan.withColumn("row", F.monotonically_increasing_id()).drop("payload"), "heads")
    order = F.struct(F.col("page").isNull().alias("none"), "page", "row")
    groups = heads.groupBy("sha256").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    groups = pin(groups.filter("n > 1").select("sha256", F.col("first.page").alias("refers_to"), F.col("first.row").alias("first_row"), "n"), "groups")
    typed = lookup_join(heads, groups, ["sha256"], weight="n")
    again = F.coalesce((F.col("row") != F.col("first_row")) & (F.col("bytes") >= least_bytes), F.lit(False))
    typed = typed.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    header = _header(F.col("record_type"), F.col("page"), F.col("url"), F.col("sha1"), F.col("bytes"), F.col("refers_to"))
    return name, pin(typed.select(header.alias("header"), "sha256", "record_type", "bytes"), "records")


def read_responses(spark: SparkSession, payloads: str, records: DataFrame) -> DataFrame:
    """header, block (the payload) and digest_ok of each response record, joined within buckets; without its payload, a null block and false."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = records.filter("record_type = 'response'").select("header", "sha256")
    stored = spark.table(payloads).hint("merge")
    out = heads.repartition(buckets, "sha256").join(stored, "sha256", "left")
    return out.select("header", F.col("payload").alias("block"), F.coalesce(F.sha2("payload", 256) == F.col("sha256"), F.lit(False)).alias("digest_ok"))


def original_records(spark: SparkSession, payloads: str, records: DataFrame) -> DataFrame:
    """The bytes of every record as a WARC file has them: header, block, two line breaks. Revisits have no block; without its payload a response is null."""
    end = F.lit(CRLF + CRLF).cast("binary")
    full = read_responses(spark, payloads, records).select(F.concat(F.col("header").cast("binary"), "block", end).alias("record"))
    return full.unionByName(records.filter("record_type = 'revisit'").select(F.concat(F.col("header").cast("binary"), end).alias("record")))


def _parsed(header: Column) -> dict[str, Column]:
    def field(name: str, value: str) -> Column:
        return F.regexp_extract(header, f"\r\n{name}: {value}\r\n", 1)

    return {
        "page_id": F.nullif(field("WARC-Record-ID", "<urn:page:([0-9-]+)>"), F.lit("")).cast("long"),
        "payload_digest": field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)"),
        "payload_bytes": field("WARC-Payload-Length", "([0-9]+)").cast("long"),
        "record_type": field("WARC-Type", "([a-z]+)"),
        "refers_to": F.nullif(field("WARC-Refers-To", "<urn:page:([0-9-]+)>"), F.lit("")).cast("long"),
    }


def read_archive(spark: SparkSession, payloads: str, records: DataFrame) -> DataFrame:
    """One row per record, from its header and, for a response, the bytes joined to it: page_id,
    payload_bytes, payload_digest, record_type, refers_to, verified (bytes, digests and lengths agree).

    A record whose payload is missing or damaged stays, with its header's digest and length if there are no bytes, and verified is false."""
    found = read_responses(spark, payloads, records)
    sha1, size = base32_sha1(F.sha1("block")), F.length("block").cast("long")
    responses = pin(
        found.select(*[c.alias(n) for n, c in _parsed(F.col("header")).items()], sha1.alias("_sha1"), size.alias("_size"), "digest_ok").withColumns(
            {
                "verified": F.coalesce(F.col("digest_ok") & (F.col("_sha1") == F.col("payload_digest")) & (F.col("_size") == F.col("payload_bytes")), F.lit(False)),
                "payload_digest": F.coalesce("_sha1", "payload_digest"),
                "payload_bytes": F.coalesce("_size", "payload_bytes"),
            }
        ).drop("_sha1", "_size", "digest_ok"), "responses",
    )
    revisits = records.filter("record_type = 'revisit'").select(*[c.alias(n) for n, c in _parsed(F.col("header")).items()])
    referred = revisits.groupBy("refers_to").agg(F.count("*").alias("n"))
    targets = responses.filter("page_id IS NOT NULL").groupBy("page_id").agg(F.max("payload_digest").alias("d"), F.max("payload_bytes").alias("b"), F.min("verified").alias("v"))
    known = pin(referred.join(targets, F.col("refers_to") == F.col("page_id")).select("refers_to", "n", "d", "b", "v"), "referred")
    again = lookup_join(revisits, known, ["refers_to"], weight="n")
    again = again.withColumn("verified", F.coalesce(F.col("v") & (F.col("d") == F.col("payload_digest")) & (F.col("b") == F.col("payload_bytes")), F.lit(False)))
    return responses.unionByName(again.withColumns({"payload_bytes": F.coalesce("b", "payload_bytes"), "payload_digest": F.coalesce("d", "payload_digest")}).drop("n", "d", "b", "v"))


def op6_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, records = write_archive(table(spark, sf_dir, "pages"))
    out = read_archive(spark, name, records)
    spark.sql(f"DROP TABLE {name}")  # what was read of it is pinned
    return out
