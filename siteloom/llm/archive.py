"""Pages to WARC archives and back, with copies as revisit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import common, warc

ID_FORM = "<urn:page:%s>"


def _record_id(id: Column) -> Column:
    return F.format_string(ID_FORM, id.cast("string"))


def page_number(record_id: Column) -> Column:
    """The page id of a record id; null if the page had none."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")


def archive_records(
    pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0
) -> DataFrame:
    """The records of ``pages``, in the columns that the archive writer takes.

    Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the smallest id is
    the response and the others revisit it. A null html is an empty payload. Repeated rows
    (same id and payload) get the same record each. A page without an id is a response only
    if no page with an id has its payload.
    """
    rows = pages.select(
        F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", warc.base32_sha1(F.col("payload")))
    # A short table: only payloads that occur twice. Spark broadcasts it if its size allows,
    # and splits the rows of a hot payload otherwise.
    copies = common.materialize(
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .select("digest", "first"),
        "archive-copies",
    )
    found = rows.join(copies, "digest", "left")
    response = F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first"))
    return found.select(
        F.coalesce(_record_id(F.col("id")), F.lit(ID_FORM % "")).alias("record_id"),
        F.when(response, "response").otherwise("revisit").alias("warc_type"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(~response, _record_id(F.col("first"))).alias("refers_to"),
        "payload",
    )


def write_archive(records: DataFrame, path: str) -> None:
    warc.register(records.sparkSession)
    records.write.format(warc.FORMAT).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    warc.register(spark)
    return spark.read.format(warc.FORMAT).option("payload", str(payload).lower()).load(path)
