"""File sources (SRC1-SRC3): markdown folders and upload admission, on Spark's binaryFile reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_UPLOAD_BYTES = 50 * 1024 * 1024


def scan_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """SRC1: (path, content) of all .md and .markdown files below ``folder``, path relative to it.

    The name filter is pushed into the file listing where its case allows; files that are not UTF-8 are
    skipped.  Order is left to the consumer: sorting a whole corpus by path is a separate step.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM]*").load(folder)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    relative = F.regexp_replace("path", r"^.*?" + _quoted(folder.rstrip("/")) + "/", "")
    named = files.where(F.lower("path").rlike(r"\.(md|markdown)$"))
    return named.select(relative.alias("path"), text.alias("content")).where(F.col("content").isNotNull())


def _quoted(path: str) -> str:
    return r"\Q" + path.replace("file:", "").rstrip("/") + r"\E"


def folder_status(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """SRC2: (folder, total_files, valid) from file paths; a folder is valid with at least one markdown file.

    ``folders(folder)`` adds listed folders without files."""
    name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    counts = files.where(F.lower("path").rlike(r"\.(md|markdown)$")).groupBy(name.alias("folder")).agg(F.count("*").alias("total_files"))
    if folders is not None:
        counts = folders.select("folder").distinct().join(counts, "folder", "left")
    return counts.select("folder", F.coalesce("total_files", F.lit(0)).alias("total_files"), (F.coalesce("total_files", F.lit(0)) > 0).alias("valid"))


def admit_uploads(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """SRC3: ``files(path, length)`` with the document name, accepted, and the reason when not."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    is_pdf, small = F.lower(base).rlike(r"\.pdf$"), F.col("length") <= max_bytes
    reason = F.when(~is_pdf, "not a pdf").when(~small, "too large")
    return files.select(
        "path", F.when(is_pdf, F.regexp_replace(base, r"(?i)\.pdf$", "")).otherwise(base).alias("name"), "length",
        (is_pdf & small).alias("accepted"), reason.alias("reason"))


def admission_counts(admitted: DataFrame) -> DataFrame:
    """SRC3: accepted and rejected uploads."""
    return admitted.groupBy("accepted").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
