"""Link-quality analytics over per-UE statistics (Q1-Q6).

The statistics table has one row per periodic report (block) per UE with
cumulative counters. Deltas, moving averages, before/after windows and
as-of lookups are equi-joins on dense block / event numbers, never a
window over a whole UE, so a UE with a third of all rows stays parallel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.operators.ordering import dense_number, neighbour
from logweave.session import cut_lineage

RSRP_GOOD = -80   # fixed values: RSRP above -80 dBm is good, below -95 poor
RSRP_POOR = -95


def counter_deltas(stats: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Q1: per-interval increments of cumulative counters; a negative step
    means the counter restarted, so the new value is the increment."""
    p = neighbour(stats, [key], "block_no", -1, counters, "_prev")
    for c in counters:
        prev = F.col(f"{c}_prev")
        d = F.when(prev.isNull() | (F.col(c) < prev), F.col(c)).otherwise(F.col(c) - prev)
        p = p.withColumn(f"d_{c}", d)
    return p.drop(*[f"{c}_prev" for c in counters])


def moving_average(df: DataFrame, key: str, n_col: str, value: str, width: int, out: str) -> DataFrame:
    """Q2: mean of ``value`` over the current and ``width-1`` previous rows
    (fewer at the start), via neighbour joins on the dense number."""
    t = df
    parts = []
    for lag in range(width - 1, 0, -1):
        t = neighbour(t, [key], n_col, -lag, [value], f"_m{lag}")
        parts.append(F.col(f"{value}_m{lag}"))
    parts.append(F.col(value))
    total = F.coalesce(parts[0], F.lit(0.0))
    for p in parts[1:]:
        total = total + F.coalesce(p, F.lit(0.0))
    cnt = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    return t.withColumn(out, total / cnt).drop(*[f"{value}_m{lag}" for lag in range(1, width)])


def quality_bucket(rsrp: Column) -> Column:
    """Q3: good / fair / poor by RSRP."""
    return (F.when(rsrp > RSRP_GOOD, F.lit("good")).when(rsrp < RSRP_POOR, F.lit("poor"))
            .otherwise(F.lit("fair")))


def _impact(events: DataFrame, numbered: DataFrame, key: str, n_col: str, value: str, offsets: list[int], first_after: int) -> DataFrame:
    """Mean ``value`` of the rows at the given offsets from each event's number
    (``n_col``), before and from ``first_after`` on; an event without such rows
    stays, with null means and counts of 0. Each event fans out to as many
    addresses as there are offsets, joined on (key, n)."""
    probe = events.select(key, "event_id", F.explode(F.array(*map(F.lit, offsets))).alias("_d"), F.col(n_col).alias("_n0"))
    probe = probe.withColumn(n_col, F.col("_n0") + F.col("_d"))
    vals = numbered.select(key, n_col, F.col(value).alias("_v"), F.lit(True).alias("_met"))
    after = F.col("_d") >= first_after
    return (probe.join(vals, [key, n_col], "left").groupBy(key, "event_id")
            .agg(F.avg(F.when(~after, F.col("_v"))).alias("before_avg"), F.avg(F.when(after, F.col("_v"))).alias("after_avg"),
                 F.count_if(F.col("_met") & ~after).alias("n_before"), F.count_if(F.col("_met") & after).alias("n_after")))


def event_impact(numbered: DataFrame, key: str, n_col: str, is_event: Column, value: str, k: int = 3) -> DataFrame:
    """Q4: mean ``value`` in the k rows before vs after each key event."""
    offsets = [o for o in range(-k, k + 1) if o]
    return _impact(numbered.where(is_event).select(key, "event_id", n_col), numbered, key, n_col, value, offsets, 1)


def block_impact(events: DataFrame, blocks: DataFrame, key: str, block: str, value: str, k: int = 3) -> DataFrame:
    """Q4 over statistics blocks: mean ``value`` in the k blocks up to the one
    in force at each event vs the k after it. ``events`` has that block's
    number (-1 before the first), as :func:`asof` gives it."""
    return _impact(events, blocks, key, block, value, list(range(1 - k, k + 1)), 1)


def event_chain(events: DataFrame, key: str, order_cols: list[str], bucket: Column, ts: str = "ts") -> DataFrame:
    """Q5: key events per UE in order with the gap to the previous one (us)."""
    n = dense_number(events, [key], order_cols, bucket, out="chain_no")
    p = neighbour(n, [key], "chain_no", -1, [ts], "_prev")
    gap = F.timestamp_diff("MICROSECOND", F.col(f"{ts}_prev"), F.col(ts))
    return p.withColumn("gap_us", gap).drop(f"{ts}_prev")


def _carried(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One task's rows of a range, sorted: every row that is no report with the
    report before it in the range, then a row that says which key came first,
    which last, and which report it ends with."""
    key = last = None  # of the row before: its key, the key's last report (an array of one)
    first: list = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, reports, is_report = batch.column("key"), batch.column("report"), batch.column("is_report").to_numpy(zero_copy_only=False)
        first = first or [keys[0].as_py()]
        differs = np.zeros(n, dtype=bool)
        unlike = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), False)
        differs[1:] = pc.or_(unlike, pc.xor(keys[1:].is_null(), keys[:-1].is_null())).to_numpy(zero_copy_only=False)
        start = np.maximum.accumulate(np.where(differs, np.arange(n), 0))
        found = np.maximum.accumulate(np.where(is_report, np.arange(n), -1))
        pool, at = reports, np.where(found >= start, found, -1)
        if last is not None and keys[0].as_py() == key:
            pool = pa.concat_arrays([reports, last])
            at = np.where((at < 0) & (start == 0), n, at)
        key = keys[n - 1].as_py()
        last = pool.slice(int(at[-1]), 1) if at[-1] >= 0 else None
        left = np.flatnonzero(~is_report)
        taken = pool.take(pa.array(at[left], mask=at[left] < 0))
        yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(left)), keys.take(pa.array(left)), taken, pa.nulls(len(left), pa.bool_())],
                                         schema=schema)
    if first:
        row, report = pa.nulls(2, schema.field("row").type), schema.field("report").type
        ends = pa.concat_arrays([pa.nulls(1, report), last.cast(report) if last is not None else pa.nulls(1, report)])
        yield pa.RecordBatch.from_arrays([row, pa.array([first[0], key], schema.field("key").type), ends, pa.array([False, True])], schema=schema)


def asof(rows: DataFrame, reports: DataFrame, key: str, order: Sequence[str], tie: str, columns: Sequence[str]) -> DataFrame:
    """Q6: each row with ``columns`` of the latest report of its key at or
    before it by ``order`` (of reports at one time the one with the greatest
    ``tie``), null if there is none.

    Rows and reports are sorted together over ranges of (key, order) at sampled
    quantiles. A task carries the last report forward within its range, and
    says with which report the range ends; a table with two rows a task carries
    these on to the ranges after. So a key of any size and any spread takes as
    many tasks as its rows need, and no row meets more than one report.
    """
    report = T.StructType([reports.schema[c] for c in columns])
    one = rows.select(F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.lit(False).alias("is_report"),
                      F.lit(None).cast(reports.schema[tie].dataType).alias("tie"), F.lit(None).cast(report).alias("report"),
                      F.struct(*rows.columns).alias("row"))
    other = reports.select(F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.lit(True), F.col(tie).alias("tie"),
                           F.struct(*columns).alias("report"), F.lit(None).cast(rows.schema).alias("row"))
    # at one time reports come first
    keys = [F.col("key"), *[F.col(f"o{i}") for i in range(len(order))], F.desc("is_report"), F.col("tie")]
    both = one.unionAll(other)
    both = both.repartitionByRange(*keys, F.rand(7)).sortWithinPartitions(*keys).select("key", "is_report", "report", "row")
    schema = T.StructType([both.schema["row"], both.schema["key"], both.schema["report"], T.StructField("ends", T.BooleanType())])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is not None:
            fields = [head.schema.field(c).with_nullable(True) for c in ("row", "key", "report")]
            yield from _carried(chain([head], batches), pa.schema([*fields, pa.field("ends", pa.bool_())]))

    table = cut_lineage(both.mapInArrow(carry, schema).withColumn("part", F.spark_partition_id()))
    edges = table.where("ends is not null").select("part", "key", "ends", "report")
    before = Window.partitionBy("key").orderBy("part", "ends").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = (edges.withColumn("carried", F.last("report", ignorenulls=True).over(before)).where(~F.col("ends") & F.col("carried").isNotNull())
              .select(F.col("part").alias("p"), F.col("key").alias("k"), "carried"))
    out = table.where("ends is null").join(F.broadcast(cut_lineage(begins)), (F.col("part") == F.col("p")) & F.col("key").eqNullSafe(F.col("k")), "left")
    return out.select("row.*", F.coalesce("report", "carried").alias("report")).select(*rows.columns, *[f"report.{c}" for c in columns])
