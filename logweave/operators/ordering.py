"""Skew-safe ordinal numbering.

Log lines carry their order in explicit columns. Numbering them with a single
``row_number() OVER (PARTITION BY log ORDER BY ...)`` puts a whole log into
one task, which breaks when one log holds a third of all lines. Instead the
order key is cut into monotone buckets: a window per (log, bucket) numbers
rows locally, a tiny table of bucket totals gets a running sum per log, and
a join adds the bucket base. Every window partition is bounded by a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.session import cut_lineage


def exclusive_prefix(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                     bucket: Column, weight: Column | None = None,
                     out: str = "offset") -> DataFrame:
    """Add ``out`` = sum of ``weight`` (1 per row when None) over the rows of
    the same group that come strictly before this row in ``order_cols`` order.

    ``bucket`` must be non-decreasing in the order key (e.g. ``id div 4096``
    or an hour truncation of a timestamp); the order key must be unique
    within a group.
    """
    g = list(group_cols)
    w = weight if weight is not None else F.lit(1)
    t = df.withColumn("_bkt", bucket).withColumn("_w", w.cast("long"))
    inner = (Window.partitionBy(*g, "_bkt").orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("_local", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    totals = t.groupBy(*g, "_bkt").agg(F.sum("_w").alias("_tot"))
    outer = Window.partitionBy(*g).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*g, "_bkt",
                           F.coalesce(F.sum("_tot").over(outer), F.lit(0)).alias("_base"))
    return (t.join(totals, [*g, "_bkt"])
            .withColumn(out, F.col("_base") + F.col("_local"))
            .drop("_bkt", "_w", "_local", "_base"))


def dense_number(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                 bucket: Column, out: str = "line_no") -> DataFrame:
    """0-based position of each row inside its group (ties are not allowed)."""
    return exclusive_prefix(df, group_cols, order_cols, bucket, None, out)


def running_sums(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                 bucket: Column, weights: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Several running sums at once with the same two-level bucket plan.
    ``inclusive`` counts the current row too."""
    g = list(group_cols)
    names = list(weights)
    t = df.withColumn("_bkt", bucket)
    for n, w in weights.items():
        t = t.withColumn(f"_w_{n}", w.cast("long"))
    frame_end = Window.currentRow if inclusive else -1
    inner = Window.partitionBy(*g, "_bkt").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, frame_end)
    for n in names:
        t = t.withColumn(f"_l_{n}", F.coalesce(F.sum(f"_w_{n}").over(inner), F.lit(0)))
    totals = t.groupBy(*g, "_bkt").agg(*[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in names])
    outer = Window.partitionBy(*g).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*g, "_bkt", *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_b_{n}")
                                         for n in names])
    out = t.join(totals, [*g, "_bkt"])
    for n in names:
        out = out.withColumn(n, F.col(f"_b_{n}") + F.col(f"_l_{n}"))
    drop = ["_bkt"] + [f"_{p}_{n}" for n in names for p in ("w", "l", "b")]
    return out.drop(*drop)


def neighbour(df: DataFrame, key_cols: Sequence[str], n_col: str, offset: int,
              cols: Sequence[str], suffix: str) -> DataFrame:
    """Attach columns of the row ``offset`` positions away in the same group
    (``offset=-1`` is SQL ``lag``). Rows are addressed by their dense number,
    so this is an equi-join on (key, n): a hot key spreads over many tasks."""
    k = list(key_cols)
    other = df.select(*k, (F.col(n_col) - F.lit(offset)).alias(n_col),
                      *[F.col(c).alias(c + suffix) for c in cols])
    return df.join(other, [*k, n_col], "left")


def range_buckets(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], out: str = "_range") -> DataFrame:
    """``df``, written, with ``out``: a bucket for the functions above that
    depends on the data's spread and not on the clock. Rows are dealt out by
    ranges of (group, order) at sampled quantiles and the range is the bucket,
    so a group with most rows in a minute has as many buckets as it needs."""
    keys = [*map(F.col, group_cols), *order_cols]
    return cut_lineage(df.repartitionByRange(*keys).withColumn(out, F.spark_partition_id()))


def range_numbered(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], out: str = "pos") -> DataFrame:
    """Add ``out``, the 0-based position of each row inside its group, by one
    sort over ranges of (group, order): a group of any size, with any spread of
    its order key, takes as many tasks as its rows need. Rows equal in both
    stand in any order (a random last key spreads them too). The sorted rows
    are written, since their numbers must not be computed twice. Null group
    columns form a group."""
    groups = [F.col(c) for c in group_cols]
    keys = [*groups, *order_cols, F.col("_any")]
    rows = df.withColumn("_any", F.rand(7))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_any").withColumn("_row", F.monotonically_increasing_id())
    rows = cut_lineage(rows).withColumn("_part", F.shiftright("_row", 33)).withColumn("_row", F.expr(f"_row & {(1 << 33) - 1}L"))
    # a row for each task of the sort
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut_lineage(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    rows = rows.join(F.broadcast(base), "_part").withColumn("_row", F.col("_base") + F.col("_row")).drop("_part", "_base")
    starts = cut_lineage(rows.groupBy(*groups).agg(F.min("_row").alias("_start")))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group_cols]
    return rows.alias("r").join(starts.alias("s"), same).select(
        *[F.col(f"r.{c}") for c in df.columns], (F.col("_row") - F.col("_start")).alias(out))
