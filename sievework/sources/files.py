"""Uploads: type checks, names, decoding, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.functions import text as tx


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Raw files with their name; the declared type follows the extension unless joined in."""
    files = spark.read.format("binaryFile").load(path)
    return files.withColumn("filename", F.element_at(F.split("path", "/"), -1))


def declared_type(filename: Column) -> Column:
    low = F.lower(filename)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx").otherwise("txt")


def detected_type(content: Column) -> Column:
    head = F.substring(content, 1, 4)
    return (
        F.when(head == F.lit(b"%PDF"), "pdf")
        .when(head == F.lit(b"PK\x03\x04"), "docx")
        .otherwise("txt")
    )


def triage_files(
    files: DataFrame, content_type: str = "content_type", max_bytes: int | None = None
) -> DataFrame:
    """Add ``safe_name`` and ``status``: ok, unsupported, too_large or type_mismatch.

    Only a caller with an upload rule passes ``max_bytes``; without it no file is too large.
    """
    too_large = F.lit(False) if max_bytes is None else F.octet_length("content") > max_bytes
    name = tx.sanitise_filename(F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.lit("unknown")))
    return files.withColumn("safe_name", name).withColumn(
        "status",
        F.when(
            ~F.coalesce(F.col(content_type).isin(lx.UPLOAD_TYPES), F.lit(False)), "unsupported"
        )
        .when(too_large, "too_large")
        .when(
            declared_type(F.col("safe_name")) != detected_type(F.col("content")), "type_mismatch"
        )
        .otherwise("ok"),
    )


def cap_text(text: Column, limit: int | None = None) -> Column:
    """For a caller that wants a fixed width; detection always reads the whole text."""
    return tx.shortened(text, limit)


def decode_text(files: DataFrame) -> DataFrame:
    """UTF-8 text of plain files, bad bytes replaced; blank files are dropped."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).filter(
        tx.nonblank(F.col("text"))
    )
