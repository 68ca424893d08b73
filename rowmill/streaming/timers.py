"""Waiting limits per status, kept by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIMEOUTS = "run_id long, status string, waiting_since timestamp, failed_at timestamp"
# Runs share state and timer by buckets, as a call for each run would cost far more than its few events. A prime, so that
# ids with a common step are dealt to all buckets.
BUCKETS = 1021
# Events without a run id are one run, in a bucket of its own: a NULL key reaches Python as NaN, which equals nothing.
NAMELESS = -1
_EVENTS = "run long, at long, event_id long, status string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WaitTimers(StatefulProcessor):
    """Tells runs that stay in a status for longer than its limit.

    State are the events of a bucket of runs that the watermark has not settled: those newer than it, as one that arrives
    late may come before them, and waits whose limit it has not passed. Once it has, every event that could have ended the
    wait has arrived, whatever the order of arrival. A timer stands at the first open end of a bucket. When nothing is open
    (a run's newest event has no limit, as final ones have none), the state is dropped.
    """

    def __init__(self, limits: Mapping[str, int]):
        self.limits = dict(limits)  # microseconds by status

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _EVENTS)

    def _settle(self, runs: Mapping[int, set[tuple]], watermark: int, nameless: bool) -> Iterator[pd.DataFrame]:
        """Report what has timed out, and keep the rest."""
        failed, kept, ends = [], [], []
        for run, known in runs.items():
            events = sorted(known)
            for i, (at, number, status) in enumerate(events):
                end = at + self.limits[status] if status in self.limits else None
                ended = i + 1 < len(events) and end is not None and events[i + 1][0] <= end
                waits = end is not None and not ended
                if waits and end <= watermark:
                    failed.append((None if nameless else run, status, at, end))
                elif waits:
                    ends.append(end)
                if at > watermark or (waits and end > watermark):
                    kept.append((run, at, number, status))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.open.put(kept)
            # Timers count milliseconds and fire once the watermark is past them.
            first = min(ends) if ends else max(k[1] for k in kept)
            self.handle.registerTimer(-(-first // 1000) - 1)
        else:
            self.open.clear()
        if failed:
            out = pd.DataFrame(failed, columns=["run_id", "status", "waiting_since", "failed_at"], dtype=object)
            times = {c: pd.to_datetime(out[c].astype("int64"), unit="us") for c in ("waiting_since", "failed_at")}
            yield out.assign(**times)

    def _stored(self) -> dict[int, set[tuple]]:
        runs: dict[int, set[tuple]] = {}
        for run, *event in self.open.get() if self.open.exists() else ():
            runs.setdefault(run, set()).add(tuple(event))
        return runs

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        runs = self._stored()
        for part in rows:
            # A repeated event is there already.
            for run, *event in zip(*(part[c].tolist() for c in ("run", "at", "event_id", "status")), strict=True):
                runs.setdefault(run, set()).add(tuple(event))
        yield from self._settle(runs, timerValues.getCurrentWatermarkInMs() * 1000, key[0] == NAMELESS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._settle(self._stored(), timerValues.getCurrentWatermarkInMs() * 1000, key[0] == NAMELESS)

    def close(self) -> None:
        pass


@contextmanager
def timer_store(spark: SparkSession):
    """The state store that timers need, for the streams started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def wait_timers(events: DataFrame, limits: Mapping[str, int], delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """``run_id, status, waiting_since, failed_at`` from a stream: ``limits`` are seconds by status.

    Events may be ``delay`` late and be repeated; those without a time are left out. Start the stream inside
    :func:`timer_store`. The number of ``buckets`` belongs to the checkpoint: a stream goes on with the one it began with.
    """
    known = events.where("ts IS NOT NULL").withWatermark("ts", delay)
    source = known.select(
        F.coalesce(F.pmod("run_id", F.lit(buckets)), F.lit(NAMELESS)).alias("bucket"), F.coalesce("run_id", F.lit(0)).alias("run"),
        "ts", F.unix_micros("ts").alias("at"),
        F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.coalesce("status", F.lit("")).alias("status"),
    )
    return source.groupBy("bucket").transformWithStateInPandas(
        WaitTimers({s: int(x * 1_000_000) for s, x in limits.items()}), outputStructType=TIMEOUTS, outputMode="Append", timeMode="EventTime"
    )


def wait_limits(events: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """The same from stored events: runs in a status with nothing after it within the status's limit.

    Repeated events count once. A run's rows are ordered in one window, as its timers are kept by one task.
    """
    after = F.lead("ts").over(W.partitionBy("run_id").orderBy("ts", "event_id"))
    seconds: Column = F.lit(None).cast("int")
    for status, limit in limits.items():
        seconds = F.when(F.col("status") == status, limit).otherwise(seconds)
    ends = F.col("ts") + F.make_interval(secs=seconds)
    rows = events.dropDuplicates(["run_id", "event_id"]).withColumns({"_next": after, "failed_at": ends})
    waits = rows.where(F.col("failed_at").isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col("failed_at"))))
    return waits.select("run_id", "status", F.col("ts").alias("waiting_since"), "failed_at")
