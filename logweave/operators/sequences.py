"""Event-sequence operators: HARQ NACK streaks, packet totals, per-process
HARQ outcome, stat-block assignment, frame unwrap (T1, T2, T4-T7).

Running counts use the bucketed two-level plan of ``ordering`` instead of a
window over a whole device, and neighbour access (``lag``) is an equi-join
on dense row numbers, so a device holding a third of all events is still
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.ordering import dense_number, neighbour, running_sums

STREAK_LIMIT = 4  # fixed value: NACKs in a row that mark HARQ exhaustion
FRAME_MODULO = 1024  # fixed value: system frame number wraps at 1024


def nack_streak(feedback: DataFrame, key: str, order_cols: list[str], bucket: Column,
                is_nack: Column, is_ack: Column, limit: int = STREAK_LIMIT) -> DataFrame:
    """Per key, NACK adds one, ACK resets to zero, other rows ignored.

    streak(row) = NACKs so far - NACKs counted at the most recent ACK. Output:
    NACK rows with ``streak`` and ``exhausted = streak >= limit``.
    """
    fb = feedback.where(is_nack | is_ack).withColumn("_nack", is_nack.cast("int")).withColumn("_ack", is_ack.cast("int"))
    cum = running_sums(fb, [key], order_cols, bucket, {"_nacks": F.col("_nack"), "_acks": F.col("_ack")})
    base = cum.where(F.col("_ack") == 1).select(key, "_acks", F.col("_nacks").alias("_base"))
    nacks = cum.where(F.col("_nack") == 1).join(base, [key, "_acks"], "left")
    streak = F.col("_nacks") - F.coalesce(F.col("_base"), F.lit(0))
    return (nacks.withColumn("streak", streak.cast("long"))
            .withColumn("exhausted", F.col("streak") >= F.lit(limit))
            .drop("_nack", "_ack", "_nacks", "_acks", "_base"))


def packet_totals(events: DataFrame, key: str, is_sent: Column, is_received: Column) -> DataFrame:
    """T4: sent / received / lost per key (conditional counts, partial agg)."""
    return (events.groupBy(key)
            .agg(F.sum(is_sent.cast("long")).alias("sent"), F.sum(is_received.cast("long")).alias("received"))
            .withColumn("lost", F.col("sent") - F.col("received")))


def harq_by_process(records: DataFrame) -> DataFrame:
    """T5: per (rnti, harq process) ACK / NACK counts and max retransmissions."""
    h = records.where(F.col("harq_fb").isin("ACK", "NACK"))
    return (h.groupBy("rnti", "harq_pid")
            .agg(F.count_if(F.col("harq_fb") == "ACK").alias("acks"),
                 F.count_if(F.col("harq_fb") == "NACK").alias("nacks"),
                 F.max("retx").alias("max_retx")))


def stat_blocks(lines: DataFrame, is_header: Column, bucket: Column) -> DataFrame:
    """Each line belongs to the latest header at or before it.
    ``block_no`` = headers so far (0 before the first header);
    ``header_line`` = line number of that header (null for block 0)."""
    t = lines.withColumn("_h", is_header.cast("int"))
    cum = running_sums(t, ["log_id"], ["line_no"], bucket, {"block_no": F.col("_h")})
    heads = cum.where(F.col("_h") == 1).select("log_id", "block_no", F.col("line_no").alias("header_line"))
    return cum.join(heads, ["log_id", "block_no"], "left").drop("_h")


def frame_unwrap(frames: DataFrame, key: str, order_cols: list[str], bucket: Column,
                 frame: str = "frame", modulo: int = FRAME_MODULO) -> DataFrame:
    """Continuous frame counter across the modulo wrap.
    A wrap is a frame number smaller than the previous one of the same key."""
    n = dense_number(frames, [key], order_cols, bucket, out="_n")
    prev = neighbour(n, [key], "_n", -1, [frame], "_prev")
    wrapped = (F.col(f"{frame}_prev").isNotNull() & (F.col(frame) < F.col(f"{frame}_prev"))).cast("int")
    w = prev.withColumn("_wrap", wrapped)
    cum = running_sums(w, [key], order_cols, bucket, {"wraps": F.col("_wrap")})
    return (cum.withColumn("unwrapped", F.col(frame) + F.col("wraps") * F.lit(modulo))
            .drop("_n", f"{frame}_prev", "_wrap"))
