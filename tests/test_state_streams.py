"""State tables kept by streams, snapshots with a source position, and timers."""

import datetime as dt
import os
import random

import pytest

from rowmill.session import scratch_dir
from rowmill.streaming import events as E
from rowmill.streaming import timers
from rowmill.streaming.state_table import StateTable

SCHEMA = "run_id long, event_id long, ts timestamp, status string"
START = dt.datetime(2024, 1, 1)


def event(run, number, hours, status="go"):
    return (run, number, START + dt.timedelta(hours=hours), status)


def arrive(spark, path, *batches):
    """Each batch becomes a file of its own, in order."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def table(spark, buckets=8):
    schema = E.latest_state(spark.createDataFrame([], SCHEMA)).schema
    return StateTable(spark, scratch_dir(spark, "state"), schema, "run_id", ["ts", "event_id", "status"], ["events"], buckets)


def state(spark, *batches):
    return sorted(tuple(r) for r in E.latest_state(spark.createDataFrame([e for b in batches for e in b], SCHEMA)).collect())


def stored(t):
    return sorted(tuple(r) for r in t.read().collect())


def files(t):
    return {d: sorted(os.listdir(os.path.join(t.path, d))) for d in os.listdir(t.path) if d.startswith("_bucket=")}


def test_state_table_counts_each_batch_once(spark):
    rng = random.Random(1)
    batches = [[event(rng.randrange(30), i * 100 + k, rng.randrange(100), rng.choice("abc")) for k in range(20)] for i in range(5)]
    t = table(spark)
    assert stored(t) == []
    for n, b in enumerate(batches):
        t.merge(E.latest_state(spark.createDataFrame(b, SCHEMA)), n)
        t.merge(E.latest_state(spark.createDataFrame(b, SCHEMA)), n)
        assert stored(t) == state(spark, *batches[: n + 1])
    # An old batch that is sent again changes nothing.
    t.merge(E.latest_state(spark.createDataFrame(batches[1], SCHEMA)), 1)
    assert stored(t) == state(spark, *batches)
    assert t.merge(E.latest_state(spark.createDataFrame([], SCHEMA)), 9) == []


def test_late_event_does_not_replace_a_newer_one(spark):
    t = table(spark)
    t.merge(E.latest_state(spark.createDataFrame([event(1, 5, 9, "new")], SCHEMA)), 0)
    t.merge(E.latest_state(spark.createDataFrame([event(1, 4, 3, "old")], SCHEMA)), 1)
    assert [r[1:2] + r[4:] for r in stored(t)] == [("new", 2)]


def test_only_touched_buckets_are_rewritten(spark):
    t = table(spark)
    t.merge(E.latest_state(spark.createDataFrame([event(i, i, i) for i in range(40)], SCHEMA)), 0)
    before = files(t)
    assert len(before) == 8
    touched = t.merge(E.latest_state(spark.createDataFrame([event(7, 100, 100)], SCHEMA)), 1)
    after = files(t)
    assert len(touched) == 1 and {d for d in after if after[d] != before[d]} == {f"_bucket={touched[0]}"}


def test_interrupted_merge_is_completed(spark, monkeypatch):
    """The driver is lost after the merged buckets were written and before they were put in place."""
    t = table(spark)
    first, second = [event(i, i, i) for i in range(10)], [event(i, 50 + i, 50) for i in range(3)]
    t.merge(E.latest_state(spark.createDataFrame(first, SCHEMA)), 0)
    place = StateTable._put_in_place
    with monkeypatch.context() as m:
        m.setattr(StateTable, "_put_in_place", lambda self: None)
        t.merge(E.latest_state(spark.createDataFrame(second, SCHEMA)), 1)
    assert StateTable._put_in_place is place
    assert stored(t) == state(spark, first, second)
    # The stream repeats the batch whose end it did not see.
    t.merge(E.latest_state(spark.createDataFrame(second, SCHEMA)), 1)
    assert stored(t) == state(spark, first, second)


def test_follow_starts_after_the_snapshot(spark):
    path, log, t = scratch_dir(spark, "in"), scratch_dir(spark, "log"), table(spark)
    early, later = [[event(1, 1, 0), event(2, 2, 1)], [event(1, 3, 2)]], [[event(1, 4, 1.5), event(3, 5, 4)], [event(2, 6, 5)]]
    arrive(spark, path, *early)
    stream = E.read_event_stream(spark, path, SCHEMA, files_per_batch=1)
    E.keep_state(stream, t, log)
    assert stored(t) == state(spark, *early)
    arrive(spark, path, *later)
    out = E.follow(stream, log, scratch_dir(spark, "out"))
    # An event that is older than the snapshot's newest one is followed too: its file was not covered.
    assert sorted(r["event_id"] for r in spark.read.schema(SCHEMA).parquet(out).collect()) == [4, 5, 6]
    assert "Join" not in stream._jdf.queryExecution().toString()
    # Nothing new: nothing more.
    again = E.follow(stream, log, scratch_dir(spark, "out"))
    assert not os.path.exists(again)
    E.keep_state(stream, t, scratch_dir(spark, "log"))
    assert {r[0] for r in stored(t)} == {1, 2, 3}


LIMITS = {"ask": 4 * 3600, "view": 2 * 3600}


def brute(events, until):
    out = []
    for run in {e[0] for e in events}:
        own = sorted({(e[2], e[1], e[3]) for e in events if e[0] == run})
        for i, (at, _, status) in enumerate(own):
            if status not in LIMITS:
                continue
            end = at + dt.timedelta(seconds=LIMITS[status])
            if end <= until and (i + 1 == len(own) or own[i + 1][0] > end):
                out.append((run, status, at, end))
    return sorted(out)


def timed(spark, *batches):
    path = scratch_dir(spark, "in")
    arrive(spark, path, *batches)
    found = timers.wait_timers(E.read_event_stream(spark, path, SCHEMA, files_per_batch=1), LIMITS)
    with timers.timer_store(spark):
        out = E.append_to_folder(found, "timers")
    return sorted(tuple(r) for r in spark.read.schema(timers.TIMEOUTS).parquet(out).collect())


@pytest.mark.parametrize("seed", range(2))
def test_timers_against_brute_force(spark, seed):
    """Random runs in six batches; up to an hour late, a third of all repeated."""
    rng = random.Random(seed)
    events = [event(rng.randrange(6), i, rng.randrange(0, 60 * 60) / 60, rng.choice(["ask", "view", "go", "done"])) for i in range(150)]
    batches = [[] for _ in range(7)]
    for e in events:
        hour = (e[2] - START).total_seconds() / 3600
        part = int(hour // 10)
        batches[part + (hour % 10 > 9.2 and rng.random() < 0.5)].append(e)
        if rng.random() < 0.3:
            batches[part].append(e)
    batches = [b for b in batches if b]
    got = timed(spark, *batches)
    assert got == brute(events, max(e[2] for e in events) - dt.timedelta(hours=1))
    stored_events = spark.createDataFrame(events + events[:20], SCHEMA)
    every = sorted(tuple(r) for r in timers.wait_limits(stored_events, LIMITS).collect())
    assert every == brute(events, dt.datetime.max)


def test_a_late_event_ends_a_wait_that_looked_over(spark):
    waits = [event(1, 1, 0, "ask")], [event(2, 2, 4.5)], [event(1, 3, 3.9)], [event(2, 9, 40)]
    assert timed(spark, *waits) == []
    assert [r[:2] for r in timed(spark, waits[0], waits[1], waits[3])] == [(1, "ask")]


def test_a_late_wait_finds_what_followed_it(spark):
    """The event that ends the wait arrives first, and is no wait itself."""
    assert timed(spark, [event(1, 2, 1.0), event(2, 8, 1.2)], [event(1, 1, 0.5, "view")], [event(2, 9, 40)]) == []


def test_state_goes_when_nothing_is_open(spark):
    path = scratch_dir(spark, "in")
    arrive(spark, path, [event(1, 1, 0, "ask"), event(2, 2, 0, "view")], [event(1, 3, 1, "done"), event(2, 4, 1, "done")], [event(9, 9, 50, "go")], [event(9, 10, 90, "go")])
    found, log = timers.wait_timers(E.read_event_stream(spark, path, SCHEMA, files_per_batch=1), LIMITS), scratch_dir(spark, "log")
    with timers.timer_store(spark):
        run = found.writeStream.outputMode("append").format("noop").option("checkpointLocation", log).trigger(availableNow=True).start()
        run.awaitTermination()
        left = spark.read.format("statestore").option("stateVarName", "open").option("flattenCollectionTypes", "true").load(log)
        # The runs that ended are gone; only what the watermark has not passed is kept.
        assert {r["key"][0] for r in left.collect()} == {9}
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_runs_share_state_and_timers(spark):
    """Many runs make no more state keys than buckets; none of their waits is lost, one without an id included."""
    path, log = scratch_dir(spark, "in"), scratch_dir(spark, "log")
    runs = [*range(-40, 40), None, 2**62 + 1]
    arrive(spark, path, [event(r, i, i / 1000, "ask") for i, r in enumerate(runs)], [event(5, 900, 0.9, "done")], [event(9, 999, 20)])
    stream = E.read_event_stream(spark, path, SCHEMA, files_per_batch=1)
    out = scratch_dir(spark, "out")
    with timers.timer_store(spark):
        found = timers.wait_timers(stream, LIMITS, buckets=7)
        run = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
        run.awaitTermination()
        first = spark.read.format("statestore").option("stateVarName", "open").option("flattenCollectionTypes", "true").option("batchId", 0).load(log)
        keys = [r["key"][0] for r in first.collect()]
        assert len(keys) == len(runs) and len(set(keys)) <= 8
    got = [tuple(r) for r in spark.read.schema(timers.TIMEOUTS).parquet(out).collect()]
    want = [(r, "ask", START + dt.timedelta(hours=i / 1000), START + dt.timedelta(hours=4 + i / 1000)) for i, r in enumerate(runs) if r != 5]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_events_without_a_time_or_status(spark):
    batches = [[(1, 1, None, "ask"), (1, None, START, None), event(2, 2, 0, "ask")], [event(3, 3, 40)], [event(3, 4, 90)]]
    assert [r[:2] for r in timed(spark, *batches)] == [(2, "ask")]


def test_repeats_within_and_beyond_the_watermark(spark):
    """A repeat in the next batch, one much later, and a late first arrival."""
    path = scratch_dir(spark, "in")
    first, late = event(1, 1, 0), event(1, 2, 0.5)
    arrive(spark, path, [first], [first, event(1, 3, 1)], [late], [event(1, 4, 30)], [first, event(1, 5, 31)])
    kept = E.deduplicated(E.read_event_stream(spark, path, SCHEMA, files_per_batch=1)).select("event_id")
    got = spark.read.schema("event_id long").parquet(E.append_to_folder(kept, "dedup"))
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3, 4, 5]
