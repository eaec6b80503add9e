"""Session helpers: a tuned local session for tests/bench, and the shared
checkpoint folder that jobs use to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def get_session(master: str | None = None, app: str = "logweave",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return (or create) a SparkSession configured for this library.

    On a cluster the existing session is reused untouched except for the SQL
    settings below, which are safe at any scale (AQE on, skew join on).
    """
    builder = SparkSession.builder.appName(app)
    if os.environ.get("LOGWEAVE_EVENT_LOG"):
        builder = (builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false")
                   .config("spark.eventLog.dir", os.environ["LOGWEAVE_EVENT_LOG"]))
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", os.environ.get("LOGWEAVE_DRIVER_MEMORY", "16g"))
            # the given tables are single files of one row group: deal their rows out (see sources.tables)
            builder = builder.config("spark.logweave.scanPartitions", str(os.cpu_count() or 1))
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # text operators are CPU-heavy per shuffled byte (regex cleaning,
        # token explode): do not let AQE merge a post-shuffle stage into one
        # task just because its input is a few MB
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The setting is read from the session; only in local mode, where the
    driver is the only executor, an unset one gets a private scratch folder.
    On a cluster an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
        path = path or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    except Exception:  # noqa: BLE001 - remote (Connect) session: only the SQL conf is visible
        sc = None
    if not path:
        master = sc.master if sc is not None else ""
        if not (master == "local" or master.startswith("local[")):
            # a folder of this machine is of no use to executors elsewhere
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="logweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    if sc is not None:
        sc.setCheckpointDir(path)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python
    workers then import it from wherever the driver was started."""
    remote = not hasattr(spark, "_jsparkSession")
    app = "connect" if remote else spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="logweave-code-"), "logweave.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(root)))
    if remote:
        spark.addArtifacts(archive, pyfile=True)
    else:
        spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


#: Largest side that is broadcast on purpose.
BROADCAST_BYTES = 64 << 20


def broadcast_below(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a written table, so counting is a read of footers) marked for
    broadcasting while its rows of at most ``row_bytes`` stay below ``most``
    bytes; beyond that the same join shuffles. Both give the same rows."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def cut_lineage(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Materialize ``df`` as a parquet table in the shared checkpoint folder
    and continue from it. One computation (an RDD checkpoint would compute
    twice without a cache); the table is on shared storage, so a lost
    executor re-reads it instead of recomputing the lineage. ``schema`` names
    the types of its columns where they stand for others (an ML vector)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
