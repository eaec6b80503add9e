"""Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import cut_lineage, ensure_checkpoint_dir, ship_package

__all__ = ["BATCH_ROWS", "bounded_broadcast", "cut_lineage", "let", "read", "row_of", "scratch", "ship_package", "small_batches", "text_of", "words"]

#: White space as the query contracts define it: a word is ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
#: Largest side that is broadcast explicitly; beyond it the same join shuffles.
BROADCAST_BYTES = 64 << 20
#: Largest Arrow batch between the JVM and a Python worker, in rows and bytes (a longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> None:
    """Lower the session's limits of an Arrow batch to ``BATCH_ROWS`` and
    ``BATCH_BYTES``: the JVM and the Python worker of every running task hold
    some batches each, outside the heap. The limits are read when a query
    runs, so they stay; they change no result."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def row_of(df: DataFrame, alias: str = "doc") -> Column:
    """All columns of a row as one struct: an operator's own columns beside it
    can't clash with names that the input brings."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(alias)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, as an array. (Splitting at one character is much
    cheaper than at a class of them.)"""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once for each row
    however often the body names it (the optimiser would otherwise repeat it
    inside a lambda for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bounded_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcasting if its counted rows stay below
    ``BROADCAST_BYTES``, unmarked (a shuffled join) beyond."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
