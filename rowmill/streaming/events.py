"""Run events: source, state, time-outs and de-duplication, for streams and for stored events alike.

Events are ``run_id long, event_id long, ts timestamp, status string``; order is (ts, event_id), never
arrival, so late or repeated input does not change an answer. Aggregations combine on the map side
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from rowmill.operators.runlog import FINAL
from rowmill.session import scratch_dir
from rowmill.streaming.state_table import StateTable

EVENT_SCHEMA = "run_id long, event_id long, ts timestamp, status string, payload string"


def read_event_stream(
    spark: SparkSession, path: str, schema: StructType | str = EVENT_SCHEMA, fmt: str = "json", glob: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """File stream over a folder of event files, in batches of so many files by age if told."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)


def latest_state(events: DataFrame) -> DataFrame:
    """``run_id, status, ts, event_id, events`` of each run's newest event."""
    newest = F.max(F.struct("ts", "event_id", "status")).alias("_last")
    grouped = events.groupBy("run_id").agg(newest, F.count(F.lit(1)).alias("events"))
    return grouped.select("run_id", "_last.status", "_last.ts", "_last.event_id", "events")


def run_deltas(events: DataFrame) -> DataFrame:
    """Run-list view of the state: ``run_id, kind, status, ts`` with kind started, progress or finished."""
    state = latest_state(events)
    kind = F.when(F.col("status").isin(*FINAL), "finished").when(F.col("events") == 1, "started").otherwise("progress")
    return state.select("run_id", kind.alias("kind"), "status", "ts")


def terminal(events: DataFrame, states: Sequence[str] = FINAL) -> DataFrame:
    """Events that end a run."""
    return events.filter(F.col("status").isin(*states))


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (run, event) once; a watermark bounds what must be remembered.

    Stored events have no watermark and are de-duplicated as a whole.
    """
    keys = ["run_id", "event_id"]
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def wait_timeouts(
    events: DataFrame, waiting: Sequence[str], limit: str = "4 hours", delay: str | None = None
) -> DataFrame:
    """``run_id, status, waiting_since, failed_at`` where a run waits and nothing follows within ``limit``.

    Streams group a run's events less than ``limit`` apart into a session, merged inside each task
    before the shuffle; a session whose last event waits is a time-out at the session's end.

    Stored events need no session: in a time slot as long as ``limit`` only a run's last event can time
    out, so each (run, slot) shrinks to its first and last event on the map side, and the event after
    a slot is the first one of the run's next slot.
    """
    last = F.max(F.struct("ts", "event_id", "status")).alias("_last")
    if events.isStreaming:
        source = events.withWatermark("ts", delay) if delay else events
        ends = source.groupBy("run_id", F.session_window("ts", limit).alias("_s")).agg(last)
        ends = ends.select("run_id", "_last", F.col("_s.end").alias("failed_at"))
    else:
        slots = events.groupBy("run_id", F.window("ts", limit).alias("_w")).agg(last, F.min("ts").alias("_first"))
        following = F.lead("_first").over(W.partitionBy("run_id").orderBy("_w"))
        ends = slots.withColumns({"_next": following, "failed_at": F.col("_last.ts") + F.expr(f"INTERVAL {limit}")})
        ends = ends.filter(F.col("_next").isNull() | (F.col("_next") > F.col("failed_at")))
    return ends.filter(F.col("_last.status").isin(*waiting)).select(
        "run_id", F.col("_last.status").alias("status"), F.col("_last.ts").alias("waiting_since"), "failed_at"
    )


def append_to_folder(stream: DataFrame, label: str, trigger: dict | None = None) -> str:
    """Run an append query over what is available and return the folder it wrote."""
    spark = stream.sparkSession
    out = scratch_dir(spark, f"{label}-out")
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_dir(spark, f"{label}-log"))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    query.awaitTermination()
    return out


def update_folder(stream: DataFrame, label: str, trigger: dict | None = None) -> str:
    """Run an update query: each batch overwrites its own sub-folder, so a repeated batch adds nothing."""
    spark = stream.sparkSession
    out = scratch_dir(spark, f"{label}-out")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", scratch_dir(spark, f"{label}-log"))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    query.awaitTermination()
    return out


def newest_batch(spark: SparkSession, folder: str, schema: StructType, key: str = "run_id") -> DataFrame:
    """State after all batches of :func:`update_folder`: the newest row of each key."""
    rows = spark.read.schema(schema.add("batch", "long")).parquet(folder)
    others = [c for c in rows.columns if c not in (key, "batch")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("_r"))
    return newest.select(key, *[F.col("_r")[c].alias(c) for c in others])


def keep_state(stream: DataFrame, table: StateTable, log: str, trigger: dict | None = None) -> None:
    """Merge the events of a stream, batch by batch, into a table of the newest state per run.

    Each batch is folded to a row per run first. ``log`` is the checkpoint: the source position that the table covers.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(latest_state(batch), number)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", log).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()


def follow(stream: DataFrame, log: str, out: str, trigger: dict | None = None) -> str:
    """Append the events after the position in ``log`` to a folder, a sub-folder per batch.

    Started on the checkpoint of :func:`keep_state` it reads only what that state does not cover, by the source's own
    position: files or offsets, not a comparison with events of the past.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return out


def snapshot_then_deltas(stored: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a new consumer gets: the current state of every run, then the events that follow it.

    ``events`` may be a stream. Events the snapshot covers are left out by their identity, not by a
    position, so one that was numbered or arrived out of order is not lost.
    """
    seen = stored.select("run_id", "event_id")
    return latest_state(stored), events.join(seen, ["run_id", "event_id"], "left_anti")
