"""Column-level building blocks (JVM expressions unless stated otherwise)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, values, col: str) -> DataFrame:
    """A small fixed one-column table built JVM-side from literals (no Python
    worker, no driver-side data transfer); safe to broadcast."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(col))
