"""Access to parquet tables (one file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read ``root/name.parquet``.

    ``spark.logweave.scanPartitions`` (unset unless a user or a local session
    of ``get_session`` sets it) deals the rows of every scan out to so many
    tasks: of use for tables that are one file of one row group, whose scan is
    one task. It depends on nothing but the setting.
    """
    df = spark.read.parquet(os.path.join(root, f"{name}.parquet"))
    tasks = int(spark.conf.get("spark.logweave.scanPartitions", "0"))
    return df.repartition(tasks) if tasks > 0 else df
