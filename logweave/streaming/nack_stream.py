"""Consecutive-NACK counter on a live stream, in event time.

Per key (RNTI / user) NACK adds one, ACK resets to zero, other events pass by.
Events may arrive late and out of order, across files and micro-batches: each
waits in the key's state until the watermark (the latest time stamp seen, less
``delay``) has passed it; a timer then takes the waiting events up to there in
order of (time, id) and carries the count on. The result equals the batch
operator ``sequences.nack_streak`` for all events that come within ``delay``;
later ones are dropped by the watermark, as in any windowed stream.

Keys are dealt out to ``GROUPS`` hash groups, and a group's keys share their
state in RocksDB: the counts that are not zero, and the events of the last
``delay`` as packed rows by time slice (a ``SLICES``-th of the delay), so that a
timer reads the slice that is due and not all that wait. Calls to the state grow
with groups and slices and not with keys and events; in a call, all keys of the
group are sorted and counted together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logweave.operators.sequences import STREAK_LIMIT
from logweave.session import cut_lineage, ensure_checkpoint_dir

OUTPUT_SCHEMA = "user_id long, event_id long, streak long, exhausted boolean"
#: How long an event waits for earlier ones.
DELAY = "1 hour"
#: Slices that a delay is cut into, and the least milliseconds of one: its waiting events are one entry of the state, and one timer.
SLICES = 8
SLICE_MS = 60_000
#: Hash groups of keys.
GROUPS = 256
#: A waiting event (n: 1 for a NACK, 0 for an ACK), or the count that a key carries on (n, at the time ``CARRIED``).
ROW = [("user_id", "<i8"), ("no_user", "?"), ("us", "<i8"), ("event_id", "<i8"), ("no_event", "?"), ("n", "<i8")]
CARRIED = -(1 << 63)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streaks(limit: int = STREAK_LIMIT, slice_ms: int = SLICE_MS) -> StatefulProcessor:
    """The state machine of a group of keys. (A class of its own for each call,
    which is sent whole: the driver's worker that sets up the state can't import
    from the archives that executors get.)"""
    class Streaks(StatefulProcessor):
        """One group."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.counts = handle.getValueState("counts", "packed binary")
            self.waiting = handle.getMapState("waiting", "slice long", "packed binary")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            for pdf in rows:
                for number, part in pdf.groupby(pdf["us"] // (slice_ms * 1000)):
                    packed = np.empty(len(part), ROW)
                    for name, _ in ROW:
                        packed[name] = part[name].to_numpy()
                    more = packed.tobytes()
                    slot = (int(number),)
                    if self.waiting.containsKey(slot):
                        more = bytes(self.waiting.getValue(slot)[0]) + more
                    else:
                        self.handle.registerTimer((slot[0] + 1) * slice_ms)  # when the slice is over
                    self.waiting.updateValue(slot, (more,))
            return iter(())

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            slot = (expiredTimerInfo.getExpiryTimeInMs() // slice_ms - 1,)
            if not self.waiting.containsKey(slot):
                return
            packed = bytes(self.waiting.getValue(slot)[0])
            if self.counts.exists():
                packed = bytes(self.counts.get()[0]) + packed
            rows = np.frombuffer(packed, ROW)
            rows = rows[np.lexsort([rows[c] for c in ("n", "event_id", "no_event", "us", "user_id", "no_user")])]
            changes = (rows["user_id"][1:] != rows["user_id"][:-1]) | (rows["no_user"][1:] != rows["no_user"][:-1])
            first = np.concatenate([[True], changes])
            # a count is the sum of n behind the last ACK, or from the key's first row
            total, n = np.cumsum(rows["n"]), rows["n"]
            start = np.maximum.accumulate(np.where(first | (n == 0), np.arange(len(rows)), 0))
            streak = total - (total - n)[start]
            last = np.concatenate([changes, [True]]) & (streak > 0)
            carried = rows[last].copy()
            carried["us"], carried["event_id"], carried["no_event"], carried["n"] = CARRIED, 0, False, streak[last]
            self.waiting.removeKey(slot)
            self.counts.update((carried.tobytes(),))
            out = (n > 0) & (rows["us"] != CARRIED)
            if out.any():
                ids = {c: pd.Series(rows[c][out]).astype("Int64").mask(rows[none][out]) for c, none in (("user_id", "no_user"), ("event_id", "no_event"))}
                yield pd.DataFrame({**ids, "streak": streak[out], "exhausted": streak[out] >= limit})

        def close(self) -> None:
            pass

    return Streaks()


def nack_streak_stream(events_stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Streaming DataFrame of NACK rows with their running streak."""
    fb = (events_stream.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
          .withWatermark("ts", delay).where(F.col("event_type").isin("error", "purchase")))
    ids = [x for c, none in (("user_id", "no_user"), ("event_id", "no_event"))
           for x in (F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c), F.col(c).isNull().alias(none))]
    fb = fb.select(F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).alias("group"), *ids, "ts", F.unix_micros("ts").alias("us"),
                   (F.col("event_type") == "error").cast("long").alias("n"))
    slice_ms = max(SLICE_MS, _micros(delay) // (1000 * SLICES))
    return fb.groupBy("group").transformWithStateInPandas(streaks(slice_ms=slice_ms), OUTPUT_SCHEMA, "append", "eventTime")


def run_available(spark: SparkSession, folder: str, schema, file_glob: str = "*.parquet", delay: str = DELAY,
                  files_per_batch: int = 1) -> DataFrame:
    """Run the stream over every file available now (``availableNow``), sink to
    parquet in the shared checkpoint folder, and return the sink as a batch
    DataFrame. A second run with an event far in the future closes the stream:
    it moves the watermark past all events that still wait."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    end = spark.sql("SELECT timestamp'2200-01-01' AS ts, 'purchase' AS event_type, CAST(NULL AS BIGINT) AS user_id, 0L AS event_id")
    end.where("false").write.parquet(f"{base}/end")
    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.session.timeZone": "UTC"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for last in (False, True):
            if last:
                end.write.mode("append").parquet(f"{base}/end")
            columns = ["user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"]
            files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", file_glob).parquet(folder)
            stream = files.select(columns).unionByName(spark.readStream.schema(end.schema).parquet(f"{base}/end").select(columns))
            q = (nack_streak_stream(stream, delay).writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/out")
                 .trigger(availableNow=True).start())
            q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(OUTPUT_SCHEMA).parquet(f"{base}/out")


def replay(spark: SparkSession, events: DataFrame, slices: int = 3, jitter: str = "20 minutes", delay: str | None = None) -> DataFrame:
    """The stream over a table's events as they might have come in: ``slices``
    appends one after the other, cut at quantiles of a time stamp that is late
    by up to ``jitter``, each event by a hash of its own. ``delay`` is jitter
    and the longest slice unless it is given."""
    late = F.unix_micros(F.col("ts").cast("timestamp")) + (F.pmod(F.xxhash64("event_id"), F.lit(1000)) * (_micros(jitter) // 1000))
    arriving = cut_lineage(events.select("user_id", "event_id", "ts", "event_type").withColumn("_late", late))
    cuts = arriving.approxQuantile("_late", [i / slices for i in range(slices + 1)], 0.01)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    for i in range(slices):
        low = F.col("_late") >= cuts[i] if i else F.lit(True)
        high = F.col("_late") < cuts[i + 1] if i < slices - 1 else F.lit(True)
        arriving.where(low & high).drop("_late").write.mode("append").parquet(path)
    longest = max((int(b - a) for a, b in zip(cuts, cuts[1:])), default=0)
    wait = delay or f"{(longest + 2 * _micros(jitter)) // 1_000_000 + 1} seconds"
    files = len(spark.read.parquet(path).inputFiles())
    return run_available(spark, path, arriving.drop("_late").schema, delay=wait, files_per_batch=max(1, files // (2 * slices)))


def _micros(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1_000_000)
