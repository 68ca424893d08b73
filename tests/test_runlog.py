import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rowmill.operators import runlog
from rowmill.streaming import events as E

START = datetime(2024, 1, 1)
def as_of():
    return F.lit("2024-06-01").cast("timestamp")


def _runs(spark, n=200, seed=2):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        status = rng.choice(["completed"] * 4 + ["failed", "executing", "cancelled", "needs_clarification"])
        started = START + timedelta(hours=i)
        finished = None if rng.random() < 0.2 else started + timedelta(days=rng.randrange(60))
        project = 0 if rng.random() < 0.4 else rng.randrange(1, 6)
        data.append((i, project, status, started, finished, f"s{i}" if status == "completed" else None, rng.random() < 0.1, i % 3 == 0, None))
    schema = (
        "run_id int, project_id int, status string, started_at timestamp, finished_at timestamp, snapshot string, "
        "pinned boolean, cancel_requested boolean, error_message string"
    )
    return data, spark.createDataFrame(data, schema).repartition(4)


def test_retention_by_count(spark):
    data, df = _runs(spark)
    got = {r["run_id"] for r in runlog.expired_by_count(df, 3).collect()}
    want = set()
    for p in range(6):
        held = [r for r in data if r[1] == p and r[2] == "completed" and not r[6]]
        held.sort(key=lambda r: (r[4] is None, -(r[4] or START).timestamp(), -r[3].timestamp(), r[0]))
        want |= {r[0] for r in held[3:]}
    assert got == want and got


def test_retention_by_age(spark):
    data, df = _runs(spark)
    got = {r["run_id"] for r in runlog.expired_by_age(df, as_of(), 100).collect()}
    limit = datetime(2024, 6, 1) - timedelta(days=100)
    assert got == {r[0] for r in data if r[2] == "completed" and not r[6] and r[4] and r[4] < limit} and got
    assert runlog.expired_by_age(df, as_of(), 0).isEmpty()


def test_cascading_undo(spark):
    rows = [(1, "a", "completed", 1, "s1"), (2, "a", "completed", 2, "s2"), (3, "a", "failed", 3, None), (4, "a", "executing", 4, None),
            (5, "b", "completed", 5, "s5"), (6, "a", "cancelled", 6, None)]
    df = spark.createDataFrame(rows, "run_id int, project_id string, status string, started_at int, snapshot string")
    out = runlog.undo(df, spark.createDataFrame([(2,)], "run_id int"), as_of())
    got = {r["run_id"]: (r["status"], r["snapshot"], r["reverted_by_run_id"]) for r in out.collect()}
    assert got == {
        1: ("completed", "s1", None), 2: ("reverted", None, None), 3: ("reverted", None, 2),
        4: ("executing", None, None), 5: ("completed", "s5", None), 6: ("cancelled", None, None),
    }
    # A run without a snapshot cannot be undone.
    assert runlog.undo(df, spark.createDataFrame([(3,)], "run_id int"), as_of()).filter("status = 'reverted'").isEmpty()


def test_recovery(spark):
    data, df = _runs(spark)
    got = {r["run_id"]: r for r in runlog.recover_interrupted(df, as_of()).collect()}
    for r in data:
        out = got[r[0]]
        if r[2] in runlog.ACTIVE:
            assert out["status"] == ("cancelled" if r[7] else "failed")
            assert out["snapshot"] is None and out["error_message"] == runlog.INTERRUPTED
            assert out["finished_at"] == (r[4] or datetime(2024, 6, 1))
        else:
            assert (out["status"], out["snapshot"], out["error_message"]) == (r[2], r[5], None)


def test_canonical_steps(spark, rows):
    runs = spark.createDataFrame([(1,), (2,)], "run_id int")
    steps = spark.createDataFrame([(1, "execute", 1, "error"), (1, "execute", 2, "success"), (1, "fix", 1, "success")], "run_id int, step string, attempt int, status string")
    got = rows(runlog.canonical_steps(runs, steps).filter("run_id = 1"), "step_no", "step", "attempt", "status")
    assert got == [
        (0, "profile", 1, "pending"), (1, "propose_schema", 1, "pending"), (2, "generate", 1, "pending"),
        (3, "execute", 1, "error"), (3, "execute", 2, "success"), (4, "validate", 1, "pending"), (5, "fix", 1, "success"),
    ]
    assert runlog.canonical_steps(runs, steps).filter("run_id = 2").count() == 5


def test_run_record_has_a_row_per_item(spark, rows):
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run_id int")
    steps = spark.createDataFrame([(1, "execute", i) for i in range(1, 151)] + [(1, "profile", 1)], "run_id int, step string, attempt int")
    questions = spark.createDataFrame([(2, 1, "q")], "run_id int, question_no int, text string")
    proposals = spark.createDataFrame([(1, 1, "p")], "run_id int, iteration int, ddl string")
    out = runlog.run_records(runs, steps, questions, proposals)
    assert out.filter("kind = 'step'").count() == 151
    assert rows(out.filter("attempt = 150 OR kind <> 'step' OR kind IS NULL")) == [
        (1, "proposal", 1, None, '{"ddl":"p"}'), (1, "step", 3, 150, '{"step":"execute"}'), (2, "question", 1, None, '{"text":"q"}'), (3, None, None, None, None),
    ]


def test_first_answer_wins(spark, rows):
    stored = spark.createDataFrame([(1, "yes", START), (2, None, None)], "question_id int, answer string, answered_at timestamp")
    sent = spark.createDataFrame([(1, "no", START), (2, "maybe", START)], "question_id int, answer string, answered_at timestamp")
    assert rows(runlog.answer(stored, sent), "question_id", "answer") == [(1, "yes"), (2, "maybe")]


def test_status_and_pin(spark, rows):
    data, df = _runs(spark, 10)
    sent = spark.createDataFrame([(0, "failed", None, True), (1, "failed", "x", False)], "run_id int, status string, error_message string, clear_snapshot boolean")
    got = {r["run_id"]: r for r in runlog.set_status(df, sent).collect()}
    assert got[0]["snapshot"] is None and got[0]["status"] == "failed" and got[0]["started_at"] == START
    assert got[1]["snapshot"] == data[1][5] and got[1]["error_message"] == "x"
    flipped = {r["run_id"]: r["pinned"] for r in runlog.toggle_pin(df, df.select("run_id")).collect()}
    assert flipped == {r[0]: (not r[6]) if r[5] else r[6] for r in data}


def test_deletable_documents(spark, rows):
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "document_id int")
    runs = spark.createDataFrame([(1, "failed"), (2, "completed"), (3, "executing"), (3, "reverted")], "document_id int, status string")
    assert rows(runlog.deletable_documents(docs, runs)) == [(1,), (4,)]


def _events(spark):
    rng = random.Random(4)
    data = []
    for i in range(300):
        run = 0 if rng.random() < 0.4 else rng.randrange(1, 8)
        at = START + timedelta(minutes=rng.randrange(0, 60 * 24 * 20))
        data.append((run, i, at, rng.choice(["executing", "needs_clarification", "completed"])))
    return data, spark.createDataFrame(data, "run_id long, event_id long, ts timestamp, status string")


def test_latest_state_ignores_arrival(spark):
    data, df = _events(spark)
    want = {}
    for run, i, at, status in sorted(data, key=lambda e: (e[2], e[1])):
        want[run] = (status, i)
    for shuffled in (df, df.orderBy(F.rand(1))):
        assert {r["run_id"]: (r["status"], r["event_id"]) for r in E.latest_state(shuffled).collect()} == want


def test_wait_timeouts_against_brute_force(spark):
    data, df = _events(spark)
    want = set()
    for run in {e[0] for e in data}:
        mine = sorted((e[2], e[1], e[3]) for e in data if e[0] == run)
        for a, b in zip(mine, [*mine[1:], None], strict=True):
            if a[2] == "needs_clarification" and (b is None or b[0] - a[0] > timedelta(hours=4)):
                want.add((run, a[0]))
    got = {(r["run_id"], r["waiting_since"]) for r in E.wait_timeouts(df, ["needs_clarification"]).collect()}
    assert got == want and want


def test_json_event_stream(spark, tmp_path, rows):
    data, df = _events(spark)
    folder = str(tmp_path / "in")
    for part in range(3):
        df.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").json(folder)
    stream = E.read_event_stream(spark, folder)
    twice = stream.unionByName(E.read_event_stream(spark, folder))
    kept = E.deduplicated(twice.drop("payload"), "30 days")
    out = spark.read.schema(kept.schema).parquet(E.append_to_folder(kept, "test-dedup"))
    assert rows(out, "event_id") == sorted([(e[1],) for e in data], key=repr)
    state = E.latest_state(stream)
    got = E.newest_batch(spark, E.update_folder(state, "test-state"), state.schema)
    assert rows(got) == rows(E.latest_state(df))


def test_terminal_and_deltas(spark):
    _, df = _events(spark)
    assert E.terminal(df).filter("status <> 'completed'").isEmpty()
    kinds = {r["kind"] for r in E.run_deltas(df).collect()}
    assert kinds <= {"started", "progress", "finished"}


def test_load_reports(spark):
    cases = {
        1: (["log", '{"rows_imported": 5, "tables": ["a", "b"]}', "bye"], (5, ["a", "b"])),
        2: (['{"rows_imported": 1}', '  {"rows_imported": 7, "tables": null}'], (7, [])),
        3: (['{"rows_imported": "7", "tables": ["a"]}'], (None, [])),
        4: (['{"rows_imported": 7, "tables": "a"}'], (None, [])),
        5: (['{"rows_imported": 7', "x"], (None, [])),
        6: (["nothing"], (None, [])),
        7: (['{"rows_imported": 7, "tables": [1, "b"]}'], (7, ["1", "b"])),
        8: (['{"rows_imported": 7, "tables": []}'], (7, [])),
        9: (['{"rows_imported": 1.5, "tables": []}'], (None, [])),
    }
    lines = [(run, i, line) for run, (text, _) in cases.items() for i, line in enumerate(text)]
    df = spark.createDataFrame(lines, "run_id int, line_no int, line string").repartition(3)
    got = {r["run_id"]: (r["rows_imported"], r["tables"]) for r in runlog.load_reports(df).collect()}
    assert got == {run: want for run, (_, want) in cases.items()}


def test_deltas_keep_late_numbers(spark, rows):
    stored = spark.createDataFrame([(1, 5, START, "executing")], "run_id long, event_id long, ts timestamp, status string")
    events = spark.createDataFrame(
        [(1, 5, START, "executing"), (1, 3, START + timedelta(hours=1), "failed")], "run_id long, event_id long, ts timestamp, status string"
    )
    state, later = E.snapshot_then_deltas(stored, events)
    assert rows(state, "status") == [("executing",)] and rows(later, "event_id") == [(3,)]


def test_listing_orders(spark):
    df = spark.createDataFrame([(1, None, 5), (2, 7, 1), (3, 9, 2), (4, 7, 0)], "id int, a int, b int").repartition(3)
    assert [r["id"] for r in runlog.newest_first(df, "a", "b").collect()] == [3, 2, 4, 1]
    assert [r["id"] for r in runlog.in_order(df, "a", "b").collect()] == [4, 2, 3, 1]
