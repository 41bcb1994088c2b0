"""A content-addressed WARC archive: each payload stored once, exact record heads beside it, records by a join.

``payloads`` holds ``(key, payload)`` with the SHA-256 of the bytes as key; ``records`` holds ``(key, head)`` where the
head is every byte of the record before its payload. A record is head, payload (none for a revisit) and two line
ends. Keys and digests are computed again from the stored bytes when the archive is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surveykit.llm.registry import query, table
from surveykit.session import scratch_path

LEAST_BYTES = 1000
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_of(html: str = "html") -> Column:
    return F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def record_heads(pages: DataFrame, date: str = DATE, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``key, page_id, head`` per page.

    Of equal payloads of ``least_bytes`` or more, the page with the largest id is the response (each of them where
    rows repeat that id) and the others revisit it; a null id is below all others. Smaller payloads are all responses.
    """
    payload = payload_of()
    keyed = pages.select("page_id", "url", F.sha2(payload, 256).alias("key"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))
    tops = keyed.groupBy("key").agg(F.max("page_id").alias("top"), F.min("sha1").alias("a"), F.max("sha1").alias("b"), F.min("bytes").alias("x"), F.max("bytes").alias("y"))
    checked = F.when((F.col("a") != F.col("b")) | (F.col("x") != F.col("y")), F.raise_error(F.concat(F.lit("two payloads share the key "), F.col("key")))).otherwise(F.col("top"))
    both = keyed.join(tops.select("key", checked.cast("long").alias("top")), "key")
    older = F.col("top").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("top")))
    revisit = (F.col("bytes") >= least_bytes) & older
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.lit(len(HTTP_HEAD)) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        F.when(uri.isNull(), "").otherwise(_line("WARC-Target-URI", uri)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _urn(F.col("top"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit("\r\n" + HTTP_HEAD),
    )
    return both.select("key", F.encode(head, "UTF-8").alias("head"))


def stored_payloads(pages: DataFrame) -> DataFrame:
    """``key, payload``, one row per distinct payload. Rows are dealt by key and page, so a hot payload is spread."""
    payload = payload_of()
    held = pages.select(F.coalesce("page_id", F.lit(-(2**63))).alias("page"), payload.alias("payload"), F.sha2(payload, 256).alias("key"))
    tops = held.groupBy("key").agg(F.max("page").alias("page"))
    return held.join(tops, ["key", "page"]).groupBy("key", "page").agg(F.first("payload").alias("payload")).select("key", "payload")


def write_archive(pages: DataFrame, folder: str, date: str = DATE, least_bytes: int = LEAST_BYTES) -> None:
    record_heads(pages, date, least_bytes).write.parquet(f"{folder}/records")
    stored_payloads(pages).write.parquet(f"{folder}/payloads")


def field(head: Column, name: str) -> Column:
    """Value of a field of the record, null where it has none. The name starts a line of the first block."""
    first = F.substring_index(head, "\r\n\r\n", 1)
    found = F.regexp_extract(first, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``head, payload, record, payload_sha1, payload_bytes`` per record; fails where stored bytes don't match.

    ``payload`` is the full one for revisits too, ``record`` the record's exact bytes.
    """
    stored = spark.read.parquet(f"{folder}/payloads").select(
        "key",
        "payload",
        F.sha1("payload").alias("payload_sha1"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        (F.sha2("payload", 256) == F.col("key")).alias("sound"),
    )
    heads = spark.read.parquet(f"{folder}/records").withColumn("head", F.decode("head", "UTF-8"))
    both = heads.join(stored, "key", "left")
    sound = F.coalesce(F.col("sound"), F.lit(False)) & (field(F.col("head"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_sha1")))
    body = F.when(field(F.col("head"), "WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    record = F.concat(F.encode("head", "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    sha1 = F.when(sound, F.col("payload_sha1")).otherwise(F.raise_error(F.concat(F.lit("payload lost or changed: "), F.col("key"))))
    return both.select("head", "payload", record.alias("record"), sha1.cast("string").alias("payload_sha1"), "payload_bytes")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
tops AS (SELECT body, max(page_id) AS top FROM p GROUP BY body)
SELECT page_id, strlen(p.body)::BIGINT AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN strlen(p.body) >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p.body) >= 1000 AND page_id < top THEN top END AS refers_to
FROM p JOIN tops USING (body)
"""


@query("op5_warc_archive", SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    archive = scratch_path(spark, "warc")
    write_archive(table(spark, folder, "pages"), archive)
    head = F.col("head")
    page = lambda name: F.regexp_extract(field(head, name), r"^<urn:x-page:(-?\d+)>$", 1)
    number = lambda found: F.when(found != "", found).cast("long")
    return read_archive(spark, archive).select(
        number(page("WARC-Record-ID")).alias("page_id"),
        "payload_bytes",
        F.col("payload_sha1").alias("payload_digest"),
        field(head, "WARC-Type").alias("record_type"),
        number(page("WARC-Refers-To")).alias("refers_to"),
    )
