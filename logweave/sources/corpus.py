"""SRC3 / SRC5 / R10: markdown corpus scans and input guards."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingInputError(FileNotFoundError):
    """A required input (corpus, chunk table, vector table) is absent."""


def scan_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """SRC3: every ``*.md`` file of ``folder`` as ordered lines
    ``(doc_id, source, ord, line)``; ``source`` is the file path.

    One row per file (``wholetext``), split in the row, so line order never
    depends on input splits. Fails when the folder holds no markdown file.
    """
    require_paths(folder)
    files = (spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
             .select(F.col("_metadata.file_path").alias("source"), F.col("value")))
    if files.isEmpty():
        raise MissingInputError(f"no markdown files found in {folder}")
    return files.select(F.xxhash64("source").alias("doc_id"), "source",
                        F.posexplode(F.split("value", "\n", -1)).alias("ord", "line")).withColumn(
        "ord", F.col("ord").cast("long"))


def list_sources(spark: SparkSession, folder: str) -> DataFrame:
    """SRC5: files of ``folder`` that are not markdown, without contents."""
    files = spark.read.format("binaryFile").load(folder).drop("content")
    return files.where(~F.col("path").rlike(r"\.md$"))


def require_paths(*paths: str) -> None:
    """Fail fast with a clear message when an input is missing."""
    missing = [p for p in paths if not _exists(p)]
    if missing:
        raise MissingInputError("required input not found: " + ", ".join(missing)
                                + " (build the chunk and vector tables first)")


def _exists(path: str) -> bool:
    if "://" in path and not path.startswith("file://"):
        return True  # remote stores are checked by Spark itself at read time
    return os.path.exists(path.replace("file://", ""))
