"""Registered streaming queries: the events table read as a file stream, up to what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.plans import views as V
from rowmill.plans.registry import query
from rowmill.session import scratch_dir
from rowmill.sources.tables import read_table
from rowmill.streaming import events as E
from rowmill.streaming import timers
from rowmill.streaming.state_table import StateTable

WAITING = ("error", "view")


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = read_table(spark, folder, "events").schema
    raw = E.read_event_stream(spark, folder, schema, "parquet", "events.parquet")
    return raw.select(
        F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status")
    )


_LATEST = f"""WITH {V.RUN_EVENTS} SELECT run_id, status, epoch_us(ts) AS at, event_id, n AS events FROM (SELECT *,
row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY run_id) AS n
FROM run_events) WHERE rn = 1"""


def _state(df: DataFrame) -> DataFrame:
    return df.select("run_id", "status", F.unix_micros("ts").alias("at"), "event_id", "events")


@query(_LATEST)
def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """State of every run from stored events."""
    return _state(E.latest_state(V.run_events(spark, folder)))


@query(_LATEST)
def stream_latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """State of every run kept by a stream."""
    state = E.latest_state(_stream(spark, folder))
    out = E.update_folder(state, "state")
    return _state(E.newest_batch(spark, out, state.schema))


@query(f"""WITH {V.RUN_EVENTS} SELECT run_id, CASE WHEN n = 1 THEN 'started' ELSE 'progress' END AS kind, status, epoch_us(ts) AS at FROM (
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY run_id) AS n
FROM run_events) WHERE rn = 1""")
def stream_run_list(spark: SparkSession, folder: str) -> DataFrame:
    """Run-list deltas of a stream, reduced to the newest per run."""
    deltas = E.run_deltas(_stream(spark, folder))
    out = E.update_folder(deltas, "list")
    return E.newest_batch(spark, out, deltas.schema).select("run_id", "kind", "status", F.unix_micros("ts").alias("at"))


@query(f"WITH {V.RUN_EVENTS} SELECT run_id, event_id, status FROM run_events")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """A reconnect sends every event twice; each is kept once."""
    twice = _stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = E.deduplicated(twice).select("run_id", "event_id", "status")
    return spark.read.schema(kept.schema).parquet(E.append_to_folder(kept, "dedup"))


@query(f"WITH {V.RUN_EVENTS} SELECT run_id, event_id FROM run_events WHERE status IN ('purchase', 'error')")
def stream_terminal(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a stream that end a run."""
    ended = E.terminal(_stream(spark, folder), ("purchase", "error")).select("run_id", "event_id")
    return spark.read.schema(ended.schema).parquet(E.append_to_folder(ended, "terminal"))


_WAITS = f"""WITH {V.RUN_EVENTS}, gaps AS (SELECT *, lead(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS next FROM run_events)
SELECT run_id, status, epoch_us(ts) AS since, epoch_us(ts + INTERVAL 4 HOUR) AS failed FROM gaps
WHERE status IN ('error', 'view') AND (next IS NULL OR next > ts + INTERVAL 4 HOUR)"""


def _waits(df: DataFrame) -> DataFrame:
    return df.select("run_id", "status", F.unix_micros("waiting_since").alias("since"), F.unix_micros("failed_at").alias("failed"))


@query(_WAITS)
def wait_timeouts(spark: SparkSession, folder: str) -> DataFrame:
    """Runs left waiting for over four hours, from stored events."""
    return _waits(E.wait_timeouts(V.run_events(spark, folder), WAITING))


@query(_WAITS + " AND ts + INTERVAL 4 HOUR <= (SELECT max(ts) FROM run_events) - INTERVAL 1 HOUR")
def stream_wait_timeouts(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stream: everything the watermark has passed."""
    found = E.wait_timeouts(_stream(spark, folder), WAITING, delay="1 hour")
    return _waits(spark.read.schema(found.schema).parquet(E.append_to_folder(found, "waits")))


@query(_LATEST)
def snapshot_then_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """A consumer that starts from the stored state and follows the later events ends in the full state."""
    stored = V.run_events(spark, folder).filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    state, later = E.snapshot_then_deltas(stored, _stream(spark, folder))
    followed = spark.read.schema(later.schema).parquet(E.append_to_folder(later, "deltas"))
    parts = state.unionByName(E.latest_state(followed))
    newest = F.max(F.struct("ts", "event_id", "status")).alias("_l")
    merged = parts.groupBy("run_id").agg(newest, F.sum("events").cast("long").alias("events"))
    return _state(merged.select("run_id", "_l.status", "_l.ts", "_l.event_id", "events"))


# JSON times are cut to milliseconds by default.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
ARRIVALS = "run_id long, event_id long, ts timestamp, status string"
# Seconds by status after which a wait has failed.
LIMITS = {"error": 4 * 3600, "view": 2 * 3600}


def _arrivals(spark: SparkSession, folder: str, path: str, parts: range, of: int = 10, repeats: bool = False) -> None:
    """Some of the ``of`` parts in which the events arrive, a JSON file each, in the order of time.

    Events of the last half hour of a part come with the next one if their number is odd. With ``repeats`` every fourth
    event comes again in the next part.
    """
    events = V.run_events(spark, folder)
    ends = events.agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b")).first()
    step = (ends["b"] - ends["a"]) // of + 1
    since = F.unix_micros("ts") - F.lit(ends["a"])
    part = F.floor(since / step).cast("int")
    late = (F.col("event_id") % 2 == 1) & (since % step > step - 1_800_000_000) & (part < of - 1)
    sent = events.withColumn("part", part + F.when(late, 1).otherwise(0))
    if repeats:
        again = sent.where((F.col("event_id") % 4 == 0) & (F.col("part") < of - 1)).withColumn("part", F.col("part") + 1)
        sent = sent.unionByName(again)
    # Stored by part, so that each file reads its own events and not all of them.
    stored = scratch_dir(spark, "sent")
    sent.where(F.col("part").between(parts.start, parts.stop - 1)).write.partitionBy("part").parquet(stored)
    sent = spark.read.schema(sent.schema).parquet(stored)
    for i in parts:
        # One file is one batch of the stream.
        sent.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").option("timestampFormat", MICROS).json(path)


def _state_table(spark: SparkSession) -> StateTable:
    schema = E.latest_state(spark.createDataFrame([], ARRIVALS)).schema
    return StateTable(spark, scratch_dir(spark, "state-table"), schema, "run_id", ["ts", "event_id", "status"], ["events"], buckets=16)


@query(_LATEST)
def stream_state_table(spark: SparkSession, folder: str) -> DataFrame:
    """State of every run in a table that ten batches of JSON events are merged into, one of them twice."""
    path, table = scratch_dir(spark, "arrivals"), _state_table(spark)
    _arrivals(spark, folder, path, range(10))
    stream = E.read_event_stream(spark, path, ARRIVALS, files_per_batch=1)

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(E.latest_state(batch), number)
        if number == 3:
            table.merge(E.latest_state(batch), number)

    run = stream.writeStream.foreachBatch(merge).option("checkpointLocation", scratch_dir(spark, "state-log")).trigger(availableNow=True).start()
    run.awaitTermination()
    return _state(table.read())


@query(_LATEST)
def snapshot_position(spark: SparkSession, folder: str) -> DataFrame:
    """A stored state with its source position, and a consumer that follows from there in several batches."""
    path, log, table = scratch_dir(spark, "arrivals"), scratch_dir(spark, "position"), _state_table(spark)
    _arrivals(spark, folder, path, range(6))
    stream = E.read_event_stream(spark, path, ARRIVALS, files_per_batch=2)
    E.keep_state(stream, table, log)
    state = table.read()
    _arrivals(spark, folder, path, range(6, 10))
    later = spark.read.schema(ARRIVALS).parquet(E.follow(stream, log, scratch_dir(spark, "later")))
    parts = state.unionByName(E.latest_state(later))
    newest = F.max(F.struct("ts", "event_id", "status")).alias("_l")
    merged = parts.groupBy("run_id").agg(newest, F.sum("events").cast("long").alias("events"))
    return _state(merged.select("run_id", "_l.status", "_l.ts", "_l.event_id", "events"))


_LIMITED = f"""WITH {V.RUN_EVENTS}, gaps AS (SELECT *, lead(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS next,
CASE status WHEN 'error' THEN ts + INTERVAL 4 HOUR WHEN 'view' THEN ts + INTERVAL 2 HOUR END AS failed_at FROM run_events)
SELECT run_id, status, epoch_us(ts) AS since, epoch_us(failed_at) AS failed FROM gaps
WHERE failed_at IS NOT NULL AND (next IS NULL OR next > failed_at)"""


@query(_LIMITED)
def wait_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that stayed in a status for longer than its own limit, from stored events."""
    return _waits(timers.wait_limits(V.run_events(spark, folder), LIMITS))


@query(_LIMITED + " AND failed_at <= (SELECT max(ts) FROM run_events) - INTERVAL 1 HOUR")
def stream_wait_timers(spark: SparkSession, folder: str) -> DataFrame:
    """The same by timers, from ten batches with late and repeated events: everything the watermark has passed."""
    path = scratch_dir(spark, "arrivals")
    _arrivals(spark, folder, path, range(10), repeats=True)
    found = timers.wait_timers(E.read_event_stream(spark, path, ARRIVALS, files_per_batch=1), LIMITS)
    with timers.timer_store(spark):
        out = E.append_to_folder(found, "timers")
    return _waits(spark.read.schema(found.schema).parquet(out))


@query(f"WITH {V.RUN_EVENTS} SELECT run_id, event_id, status FROM run_events")
def stream_dedup_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Events that come late, and some again with the next batch, are kept once each."""
    path = scratch_dir(spark, "arrivals")
    _arrivals(spark, folder, path, range(10), repeats=True)
    kept = E.deduplicated(E.read_event_stream(spark, path, ARRIVALS, files_per_batch=1)).select("run_id", "event_id", "status")
    return spark.read.schema(kept.schema).parquet(E.append_to_folder(kept, "dedup"))
