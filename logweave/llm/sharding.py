"""Two-pass external shuffle into shards (operator 4).

Pass 1 scatters every record into a bucket by a seeded hash of its id; there
are as many buckets as it takes to keep one in a task's memory. Pass 2 reads a
bucket as a whole, shuffles it (Fisher-Yates with a seed of its own) and writes
it. The buckets one after the other are then one random order of all records;
shard ``s`` of ``n`` is the ``s``-th of ``n`` equal runs of that order, so
counts differ by at most one (the law ``rows``).

Edge cases: a null text has no bytes (size 1); rows with a null id are
scattered by their place in the input; rows with equal ids share a bucket and
are told apart by a hash of the text, equal rows are interchangeable; an empty
table gives an empty table, and shards may be empty; other columns, whatever
their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import BATCH_ROWS, cut_lineage, row_of, small_batches, text_of

N_SHARDS = 16
#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 16 << 20
SEED = 20240


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniformly random order of ``0 .. n - 1``."""
    order = np.arange(n)
    swaps = rng.integers(0, np.arange(n, 0, -1)) if n else []  # for i = n - 1, ..., 0: one of the first i + 1
    for i, j in zip(range(n - 1, -1, -1), swaps):
        order[i], order[j] = order[j], order[i]
    return order


def shuffled_buckets(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED,
                     bucket_bytes: int = BUCKET_BYTES, n_shards: int = N_SHARDS) -> DataFrame:
    """``(doc, size, bucket, pos)``: every record with its bucket and its
    place in the shuffled bucket."""
    size = F.octet_length(text_of(text)).cast("bigint") + 1
    small_batches(docs)
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n_buckets = max(n_shards, -(-total // bucket_bytes))
    place = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id()))
    rows = docs.select(row_of(docs), size.alias("size"), F.pmod(F.xxhash64(F.lit(seed), place), F.lit(n_buckets)).alias("bucket"),
                       F.xxhash64(F.lit(seed + 1), place, F.col(text)).alias("tie"))

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = pa.Table.from_batches(list(batches))
        # a fixed order first: the result doesn't depend on the order of arrival
        tie = bucket["tie"].to_numpy()
        fixed = np.argsort(tie, kind="stable")
        at = int(bucket["bucket"][0].as_py()) if len(tie) else 0
        order = fixed[fisher_yates(len(tie), np.random.default_rng([seed, at]))]
        out = bucket.select(["doc", "size", "bucket"]).take(pa.array(order))
        yield from out.append_column("pos", pa.array(np.arange(len(order), dtype=np.int64))).to_batches(max_chunksize=BATCH_ROWS)

    schema = T.StructType([*rows.schema.fields[:3], T.StructField("pos", T.LongType())])
    return rows.groupBy("bucket").applyInArrow(shuffle, schema)


def sharded(docs: DataFrame, text: str = "text", key: str = "doc_id", n_shards: int = N_SHARDS, seed: int = SEED,
            bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(doc, size, shard, slot)``, read back from the shuffled buckets,
    which are written below the shared folder. The running count of buckets is
    a table with a row for each bucket."""
    table = cut_lineage(shuffled_buckets(docs, text, key, seed, bucket_bytes, n_shards))
    counts = table.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cut_lineage(counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                                     F.sum("n").over(Window.partitionBy()).alias("all")))
    placed = table.join(base, "bucket").withColumn("at", F.col("base") + F.col("pos"))
    placed = placed.withColumn("shard", F.expr(f"cast((at * {n_shards}) div all as int)"))
    first = F.expr(f"(shard * all + {n_shards - 1}) div {n_shards}")  # where the shard begins
    return placed.select("doc", "size", "shard", (F.col("at") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write ``(doc, size, slot)`` as folders ``shard=0 .. n - 1`` below
    ``path``, the rows of each file in slot order."""
    sharded(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
