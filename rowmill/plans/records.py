"""Registered join, change, version and run-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators import changes, normalize, runlog
from rowmill.operators.asof import convert_currency
from rowmill.operators.catalog import upsert
from rowmill.operators.versions import VersionStore
from rowmill.plans import views as V
from rowmill.plans.registry import query
from rowmill.session import scratch_dir
from rowmill.sources.tables import read_table

_AS_OF = "2001-09-01 00:00:00"


def _as_of():
    return F.lit(_AS_OF).cast("timestamp_ntz")


# -- joins ---------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_custkey AS customer_id FROM orders JOIN customer ON 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') = c_name")
def fk_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Natural key of the child (the customer's name) replaced by the parent's id."""
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey"])
    child = o.select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("c_name"))
    parent = read_table(spark, folder, "customer", ["c_name", "c_custkey"])
    return normalize.fk_lookup(child, parent, "c_name", "c_custkey", "customer_id")


@query(f"""WITH {V.DIRTY_ORDERS}, {V.RATES} SELECT k, d.currency, rate,
CASE WHEN d.currency = 'USD' THEN amount ELSE amount * rate END AS usd FROM
(SELECT k, currency, o_orderdate AS at, CAST(CAST(substr(amount_s, 2) AS DECIMAL(18,2)) AS DOUBLE) AS amount
 FROM dirty_orders JOIN orders ON k = o_orderkey) d
ASOF LEFT JOIN rates r ON d.currency = r.currency AND d.at >= r.day""")
def asof_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts in dollars at the latest rate on or before the order date."""
    from rowmill.functions import convert as C

    d = V.dirty_orders(spark, folder).select(
        "k", "currency", C.to_date(F.col("order_date_s")).alias("at"), C.to_amount(F.col("amount_s")).cast("double").alias("amount")
    )
    usd = convert_currency(d, V.rates(spark, folder), "amount", "currency", "at", "usd")
    return usd.select("k", "currency", "rate", "usd")


@query(f"""WITH {V.RUNS} SELECT n_nationkey AS project_id, n_name AS project, coalesce(d, 0) AS docs_count, coalesce(r, 0) AS completed_imports
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS d FROM customer GROUP BY 1) a ON n_nationkey = a.c_nationkey
LEFT JOIN (SELECT project_id, count(*) AS r FROM runs WHERE status = 'completed' GROUP BY 1) b ON n_nationkey = b.project_id""")
def project_stats(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.project_stats(V.projects(spark, folder), V.run_documents(spark, folder), V.runs(spark, folder))


@query(f"""WITH {V.RUNS} SELECT run_id, status, c_name AS document, n_name AS project FROM runs JOIN customer ON document_id = c_custkey
JOIN nation ON project_id = n_nationkey""")
def enriched_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = V.run_documents(spark, folder).drop("project_id")
    out = runlog.enriched_runs(V.runs(spark, folder), documents, V.projects(spark, folder))
    return out.select("run_id", "status", "document", "project")


@query(f"""WITH {V.RUNS} SELECT c_custkey AS document_id, c_nationkey AS project_id, c_name AS document FROM customer
WHERE c_custkey NOT IN (SELECT document_id FROM runs WHERE status NOT IN ('failed', 'cancelled', 'reverted'))""")
def deletable_documents(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.deletable_documents(V.run_documents(spark, folder), V.runs(spark, folder))


@query(f"""WITH {V.RUNS} SELECT event_id, run_id, status FROM (SELECT event_id, user_id AS run_id FROM events) LEFT JOIN
(SELECT run_id, status FROM runs WHERE status = 'failed') USING (run_id)""")
def attach_parent(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with their change, if there is one."""
    messages = read_table(spark, folder, "events", ["event_id", "user_id"]).withColumnRenamed("user_id", "run_id")
    failed = V.runs(spark, folder).filter("status = 'failed'").select("run_id", "status")
    return runlog.attach_parent(messages, failed, "run_id")


# -- changes -------------------------------------------------------------------------------------

_LOWER = changes.Change("orders", "update", "email <> lower(email)", {"email": "lower(email)"}, summary="Lower-case e-mails")


@query(f"""WITH {V.DIRTY_ORDERS} SELECT count(*) FILTER (WHERE email <> lower(email)) AS affected_rows, count(*) AS total_rows FROM dirty_orders""")
def change_dry_run(spark: SparkSession, folder: str) -> DataFrame:
    return _LOWER.dry_run(V.dirty_orders(spark, folder))


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, lower(email) AS email FROM dirty_orders""")
def change_apply_update(spark: SparkSession, folder: str) -> DataFrame:
    return _LOWER.apply(V.dirty_orders(spark, folder).select("k", "email"))


@query(f"""WITH {V.DIRTY_ORDERS} (SELECT k, 'email' AS column_name, email AS before, lower(email) AS after FROM dirty_orders
WHERE email <> lower(email) ORDER BY k LIMIT 4)""")
def change_preview(spark: SparkSession, folder: str) -> DataFrame:
    out = changes.preview(V.dirty_orders(spark, folder).select("k", "email"), _LOWER, ["k"])
    return out.withColumnRenamed("column", "column_name")


@query(f"""WITH {V.ORPHAN_ORDERS} SELECT * FROM orphan_orders WHERE o_custkey IS NULL OR o_custkey < 1000000""")
def change_delete(spark: SparkSession, folder: str) -> DataFrame:
    """A row whose predicate is unknown stays."""
    return changes.Change("orders", "delete", "o_custkey >= 1000000").apply(V.orphan_orders(spark, folder))


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name, NULL FROM supplier""")
def change_insert(spark: SparkSession, folder: str) -> DataFrame:
    s = read_table(spark, folder, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name"))
    change = changes.Change("customer", "insert", rows=s)
    return change.apply(read_table(spark, folder, "customer", ["c_custkey", "c_name", "c_acctbal"]))


@query(f"""WITH {V.CUSTOMER_V2} SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey,
CASE WHEN b.c_custkey IS NULL THEN a.c_mktsegment ELSE b.c_mktsegment END AS c_mktsegment,
CASE WHEN b.c_custkey IS NULL THEN a.c_acctbal ELSE b.c_acctbal END AS c_acctbal
FROM customer a FULL JOIN customer_v2 b ON a.c_custkey = b.c_custkey""")
def change_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Matched customers overwritten, new ones added, the others kept."""
    columns = ["c_custkey", "c_mktsegment", "c_acctbal"]
    change = changes.Change("customer", "merge", rows=V.customer_v2(spark, folder).select(*columns), keys=["c_custkey"])
    return change.apply(read_table(spark, folder, "customer", columns))


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, email AS contact, o_custkey * 10 AS ten_fold, try_cast(qty_s AS INTEGER) AS qty_s FROM dirty_orders""")
def change_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Columns added, dropped, renamed and safely retyped."""
    df = V.dirty_orders(spark, folder).select("k", "email", "o_custkey", "qty_s")
    for change in (
        changes.Change("orders", "add_column", values={"ten_fold": "o_custkey * 10"}),
        changes.Change("orders", "drop_column", values={"o_custkey": ""}),
        changes.Change("orders", "rename_column", values={"email": "contact"}),
        changes.Change("orders", "retype", values={"qty_s": "int"}),
    ):
        df = change.apply(df)
    return df


@query(f"""WITH {V.DIRTY_ORDERS}, places AS (SELECT row_number() OVER (ORDER BY address_s) AS address_id, address_s
FROM (SELECT DISTINCT address_s FROM dirty_orders)) SELECT k, address_id FROM dirty_orders JOIN places USING (address_s)""")
def change_split_out(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses moved to a table of their own; the orders keep an id."""
    df = V.dirty_orders(spark, folder).select("k", "address_s")
    places = normalize.surrogate_ids(normalize.extract_entity(df, "address_s", []), ["address_s"], "address_id")
    return normalize.fk_lookup(df, places, "address_s", "address_id", "address_id")


@query(f"""WITH {V.CUSTOMER_V2} SELECT * FROM (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey,
CASE WHEN a.c_custkey IS NULL THEN 'insert' WHEN b.c_custkey IS NULL THEN 'delete'
 WHEN a.c_name IS DISTINCT FROM b.c_name OR a.c_nationkey IS DISTINCT FROM b.c_nationkey OR a.c_acctbal IS DISTINCT FROM b.c_acctbal
 OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'update' END AS change
FROM customer a FULL JOIN customer_v2 b ON a.c_custkey = b.c_custkey) WHERE change IS NOT NULL""")
def version_diff(spark: SparkSession, folder: str) -> DataFrame:
    return changes.row_diff(read_table(spark, folder, "customer"), V.customer_v2(spark, folder), ["c_custkey"])


@query(f"""WITH {V.CUSTOMER_V2} SELECT a.c_custkey, 'c_mktsegment' AS column_name, a.c_mktsegment AS before, b.c_mktsegment AS after
FROM customer a JOIN customer_v2 b ON a.c_custkey = b.c_custkey WHERE a.c_mktsegment <> b.c_mktsegment""")
def cell_changes(spark: SparkSession, folder: str) -> DataFrame:
    out = changes.cell_diff(read_table(spark, folder, "customer"), V.customer_v2(spark, folder), ["c_custkey"])
    return out.withColumnRenamed("column", "column_name")


@query("""SELECT n_nationkey, CASE state WHEN 'applied' THEN lower(n_name) ELSE n_name END AS n_name, state
FROM nation, (VALUES ('applied'), ('undone')) AS s(state)""")
def change_life_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """A stored table after a change was applied, and after it was undone."""
    store = VersionStore(spark, scratch_dir(spark, "changes"))
    store.load({"nation": read_table(spark, folder, "nation", ["n_nationkey", "n_name"])})
    book = changes.ChangeBook(store)
    change_id = book.propose(changes.Change("nation", "update", "n_name <> lower(n_name)", {"n_name": "lower(n_name)"}))
    book.apply(change_id)
    applied = store.read("nation").withColumn("state", F.lit("applied"))
    book.undo(change_id)
    return applied.unionByName(store.read("nation").withColumn("state", F.lit("undone")))


# -- retention and undo --------------------------------------------------------------------------


@query(f"""WITH {V.RUNS} SELECT run_id, project_id, snapshot FROM (SELECT *, row_number() OVER (PARTITION BY project_id
ORDER BY finished_at DESC NULLS LAST, started_at DESC, run_id) AS rk FROM runs
WHERE status = 'completed' AND NOT pinned AND snapshot IS NOT NULL) WHERE rk > 10""")
def retention_by_count(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.expired_by_count(V.runs(spark, folder)).select("run_id", "project_id", "snapshot")


@query(f"""WITH {V.RUNS} SELECT run_id, snapshot FROM runs WHERE status = 'completed' AND NOT pinned AND snapshot IS NOT NULL
AND finished_at < TIMESTAMP '{_AS_OF}' - INTERVAL 1000 DAY""")
def retention_by_age(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.expired_by_age(V.runs(spark, folder), _as_of(), 1000).select("run_id", "snapshot")


@query(f"""WITH {V.RUNS} SELECT run_id, snapshot, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at, pinned,
coalesce(bytes, 0) AS size_bytes FROM runs LEFT JOIN (SELECT l_orderkey, count(*) AS bytes FROM lineitem GROUP BY 1) ON run_id = l_orderkey
WHERE snapshot IS NOT NULL""")
def snapshot_list(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots with a size (here the line count of the run), newest first."""
    l = read_table(spark, folder, "lineitem", ["l_orderkey"])
    sizes = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size_bytes"))
    sizes = sizes.select(F.concat(F.lit("v"), F.col("l_orderkey").cast("string")).alias("snapshot"), "size_bytes")
    out = runlog.snapshot_list(V.runs(spark, folder), sizes)
    return out.withColumn("finished_at", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {V.RUNS}, t AS (SELECT project_id, min(struct_pack(started_at, run_id)) AS t FROM runs
WHERE status = 'completed' AND snapshot IS NOT NULL AND cancel_requested GROUP BY 1)
SELECT r.run_id, CASE WHEN r.run_id = t.t.run_id OR (status IN ('completed', 'failed') AND started_at > t.t.started_at)
  THEN 'reverted' ELSE status END AS status,
 CASE WHEN r.run_id = t.t.run_id OR (status IN ('completed', 'failed') AND started_at > t.t.started_at) THEN NULL ELSE snapshot END AS snapshot,
 CASE WHEN r.run_id <> t.t.run_id AND status IN ('completed', 'failed') AND started_at > t.t.started_at THEN t.t.run_id END
  AS reverted_by_run_id FROM runs r LEFT JOIN t USING (project_id)""")
def cascade_undo(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's earliest undoable run with a cancel request is undone, with everything after it."""
    runs = V.runs(spark, folder)
    targets = runs.filter("cancel_requested").select("run_id")
    return runlog.undo(runs, targets, _as_of()).select("run_id", "status", "snapshot", "reverted_by_run_id")


@query(f"""WITH {V.RUNS}, t AS (SELECT project_id, min(started_at) AS s FROM runs WHERE status = 'failed' GROUP BY 1)
SELECT project_id, run_id FROM runs JOIN t USING (project_id) WHERE status IN ('completed', 'failed') AND started_at > s""")
def later_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that came after each project's first failure."""
    runs = V.runs(spark, folder)
    first = runs.filter("status = 'failed'").groupBy("project_id").agg(F.min("started_at").alias("target_started"))
    return runlog.later_runs(runs, first).select("project_id", "run_id")


@query(f"""WITH {V.RUNS} SELECT run_id, status = 'completed' AND snapshot IS NOT NULL AS undo_available FROM runs""")
def undo_available(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.with_undo_flag(V.runs(spark, folder)).select("run_id", "undo_available")


@query(f"""WITH {V.RUNS} SELECT run_id, CASE WHEN cancel_requested AND snapshot IS NOT NULL THEN NOT pinned ELSE pinned END AS pinned FROM runs""")
def pin_toggle(spark: SparkSession, folder: str) -> DataFrame:
    runs = V.runs(spark, folder)
    return runlog.toggle_pin(runs, runs.filter("cancel_requested").select("run_id")).select("run_id", "pinned")


@query(f"""WITH {V.RUNS} SELECT run_id, project_id FROM runs WHERE project_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def delete_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Run rows left after the projects of one region are deleted."""
    gone = read_table(spark, folder, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("project_id"))
    return runlog.without_project(V.runs(spark, folder), gone).select("run_id", "project_id")


# -- run log -------------------------------------------------------------------------------------


@query(f"""WITH {V.RUNS} SELECT project_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY project_id
ORDER BY started_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1""")
def latest_proposal(spark: SparkSession, folder: str) -> DataFrame:
    """The newest record of each group."""
    runs = V.runs(spark, folder).select("project_id", "run_id", "status", F.struct("started_at", F.col("run_id").alias("r")).alias("at"))
    return runlog.latest_per_group(runs, "project_id", "at").drop("at")


_ACTIVE_SQL = ", ".join(f"'{s}'" for s in runlog.ACTIVE)


@query(f"""WITH {V.RUNS} SELECT run_id, CASE WHEN status NOT IN ({_ACTIVE_SQL}) THEN status WHEN cancel_requested THEN 'cancelled'
 ELSE 'failed' END AS status, strftime(CASE WHEN status IN ({_ACTIVE_SQL}) THEN coalesce(finished_at, TIMESTAMP '{_AS_OF}') ELSE finished_at END,
 '%Y-%m-%d %H:%M:%S') AS finished_at, CASE WHEN status IN ({_ACTIVE_SQL}) THEN coalesce(error_message, '{runlog.INTERRUPTED}')
 ELSE error_message END AS error_message, CASE WHEN status NOT IN ({_ACTIVE_SQL}) THEN snapshot END AS snapshot FROM runs""")
def recover_runs(spark: SparkSession, folder: str) -> DataFrame:
    out = runlog.recover_interrupted(V.runs(spark, folder), _as_of())
    return out.select("run_id", "status", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"), "error_message", "snapshot")


@query(f"""WITH {V.RUNS}, u AS (SELECT o_orderkey AS run_id, 'failed' AS status, CASE WHEN o_orderstatus = 'O' THEN 'late' END AS error_message
FROM orders WHERE o_orderstatus <> 'F')
SELECT r.run_id, coalesce(u.status, r.status) AS status, coalesce(u.error_message, r.error_message) AS error_message,
CASE WHEN u.run_id IS NULL THEN snapshot END AS snapshot FROM runs r LEFT JOIN u USING (run_id)""")
def status_update(spark: SparkSession, folder: str) -> DataFrame:
    """Partial update: only the supplied fields change, snapshots are cleared."""
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_orderstatus"]).filter("o_orderstatus <> 'F'")
    sent = o.select(
        F.col("o_orderkey").alias("run_id"),
        F.lit("failed").alias("status"),
        F.when(F.col("o_orderstatus") == "O", "late").alias("error_message"),
        F.lit(True).alias("clear_snapshot"),
    )
    runs = V.runs(spark, folder).select("run_id", "status", "error_message", "snapshot")
    return runlog.set_status(runs, sent)


@query(f"""WITH {V.STEPS_SQL} SELECT run_id, step, attempt, status, strftime(started_at, '%Y-%m-%d') AS day FROM steps""")
def step_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts numbered per (run, step) in start order."""
    return V.steps(spark, folder).select("run_id", "step", "attempt", "status", F.date_format("started_at", "yyyy-MM-dd").alias("day"))


_GROUPED_STEPS = f"""{V.RAW_STEPS}, a AS (SELECT run_id, step, 1 AS attempt, min(started_at) AS started_at, max(status) AS status,
min(l_suppkey) AS title FROM raw_steps GROUP BY 1, 2)"""


def _stored_steps(spark: SparkSession, folder: str) -> DataFrame:
    return V.raw_steps(spark, folder).groupBy("run_id", "step").agg(
        F.lit(1).alias("attempt"), F.min("started_at").alias("started_at"), F.max("status").alias("status"), F.min("l_suppkey").alias("title")
    )


@query(f"""WITH {_GROUPED_STEPS}, s AS (SELECT run_id, step, attempt, CASE WHEN title < 50 THEN started_at END AS started_at, status, title FROM a
 WHERE title < 80), u AS (SELECT run_id, step, attempt, started_at + INTERVAL 1 DAY AS started_at, 'success' AS status, title + 1000 AS title
 FROM a WHERE title > 20)
SELECT coalesce(s.run_id, u.run_id) AS run_id, coalesce(s.step, u.step) AS step, coalesce(s.attempt, u.attempt) AS attempt,
 strftime(coalesce(s.started_at, u.started_at), '%Y-%m-%d') AS day, coalesce(u.status, s.status) AS status, coalesce(s.title, u.title) AS title
FROM s FULL JOIN u ON s.run_id = u.run_id AND s.step = u.step AND s.attempt = u.attempt""")
def step_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Step rows sent again: first start and title stay, the rest is overwritten."""
    a = _stored_steps(spark, folder)
    stored = a.filter("title < 80").withColumn("started_at", F.when(F.col("title") < 50, F.col("started_at")))
    sent = a.filter("title > 20").select(
        "run_id", "step", "attempt", (F.col("started_at") + F.make_interval(days=F.lit(1))).alias("started_at"),
        F.lit("success").alias("status"), (F.col("title") + 1000).alias("title"),
    )
    out = runlog.upsert_steps(stored, sent)
    return out.select("run_id", "step", "attempt", F.date_format("started_at", "yyyy-MM-dd").alias("day"), "status", "title")


_STEP_VALUES = ", ".join(f"('{s}', {i})" for i, s in enumerate(runlog.STEPS))


@query(f"""WITH {_GROUPED_STEPS}, canon AS (SELECT * FROM (VALUES {_STEP_VALUES}) AS c(step, step_no))
SELECT o_orderkey AS run_id, canon.step, coalesce(a.attempt, 1) AS attempt, coalesce(a.status, 'pending') AS status, step_no
FROM orders CROSS JOIN canon LEFT JOIN a ON a.run_id = o_orderkey AND a.step = canon.step""")
def canonical_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Every run shows the five canonical steps; missing ones are pending."""
    runs = read_table(spark, folder, "orders", ["o_orderkey"]).withColumnRenamed("o_orderkey", "run_id")
    out = runlog.canonical_steps(runs, _stored_steps(spark, folder).drop("title", "started_at"))
    return out.select("run_id", "step", "attempt", "status", "step_no")


@query(f"""WITH {V.RAW_STEPS} SELECT run_id, step, l_partkey, CAST(date_diff('millisecond', started_at, finished_at) AS BIGINT) AS duration_ms FROM raw_steps""")
def step_durations(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.step_durations(V.raw_steps(spark, folder)).select("run_id", "step", "l_partkey", "duration_ms")


@query(f"""WITH {V.STEPS_SQL} SELECT run_id, max(attempt) AS attempts, count(*) AS steps, count(*) FILTER (WHERE status = 'error') AS failed_steps
FROM steps GROUP BY 1""")
def fix_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.fix_statistics(V.steps(spark, folder))


@query("""SELECT user_id AS run_id, count(*) AS questions, count(*) FILTER (WHERE event_type = 'click') AS auto_decided FROM events GROUP BY 1""")
def auto_decisions(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events", ["user_id", "event_type"])
    return runlog.auto_decisions(e.select(F.col("user_id").alias("run_id"), (F.col("event_type") == "click").alias("auto_decision")))


_QUESTIONS = """q AS (SELECT event_id AS question_id, CASE WHEN event_type = 'click' THEN props END AS answer,
CASE WHEN event_type = 'click' THEN ts END AS answered_at FROM events)"""


@query(f"""WITH {_QUESTIONS} SELECT question_id, coalesce(answer, 'late') AS answer,
strftime(coalesce(answered_at, TIMESTAMP '{_AS_OF}'), '%Y-%m-%d') AS day FROM q""")
def first_answer(spark: SparkSession, folder: str) -> DataFrame:
    """A second answer to an answered question changes nothing."""
    e = read_table(spark, folder, "events", ["event_id", "event_type", "props", "ts"])
    given = F.col("event_type") == "click"
    questions = e.select(
        F.col("event_id").alias("question_id"), F.when(given, F.col("props")).alias("answer"), F.when(given, F.col("ts")).alias("answered_at")
    )
    late = questions.select("question_id", F.lit("late").alias("answer"), _as_of().alias("answered_at"))
    out = runlog.answer(questions, late)
    return out.select("question_id", "answer", F.date_format("answered_at", "yyyy-MM-dd").alias("day"))


@query(f"""WITH {V.RUNS}, {V.STEPS_SQL}, items AS (
SELECT run_id, 'step' AS kind, step_no AS no, attempt, '{{"step":"' || step || '","status":"' || status || '"}}' AS item
FROM steps JOIN (VALUES {_STEP_VALUES}) AS c(step, step_no) USING (step)
UNION ALL SELECT user_id, 'question', row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), NULL, '{{"event_id":' || event_id || '}}' FROM events
UNION ALL SELECT o_orderkey, 'proposal', n, NULL, '{{"table":"t' || (o_custkey % 7) || '"}}' FROM orders, range(1, 4) AS r(n) WHERE o_orderkey % 3 + 1 >= n)
SELECT runs.run_id, runs.status, kind, no, attempt, item FROM runs LEFT JOIN items USING (run_id)""")
def run_record(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with their steps, questions and proposals, one row per item."""
    from rowmill.operators.ranking import numbered

    e = V.run_events(spark, folder).select("run_id", "ts", "event_id")
    questions = numbered(e, ["run_id"], ["ts", "event_id"], "question_no").select("run_id", "question_no", "event_id")
    orders = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey"])
    tries = F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("iteration")
    table = F.concat(F.lit("t"), (F.col("o_custkey") % 7).cast("string")).alias("table")
    proposals = orders.select(F.col("o_orderkey").alias("run_id"), tries, table)
    steps = V.steps(spark, folder).select("run_id", "step", "attempt", "status")
    return runlog.run_records(V.runs(spark, folder).select("run_id", "status"), steps, questions, proposals)


@query("""SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS c_name, coalesce(s_acctbal, c_acctbal) AS c_acctbal
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def keyed_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers written over customers of the same number."""
    s = read_table(spark, folder, "supplier")
    sent = s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return upsert(read_table(spark, folder, "customer", ["c_custkey", "c_name", "c_acctbal"]), sent, ["c_custkey"])


@query(f"""WITH {V.RUNS} SELECT run_id, strftime(finished_at, '%Y-%m-%d') AS day FROM runs""")
def newest_first(spark: SparkSession, folder: str) -> DataFrame:
    """Run listing, newest first with unfinished runs last."""
    out = runlog.newest_first(V.runs(spark, folder), "finished_at", "started_at", "run_id")
    return out.select("run_id", F.date_format("finished_at", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, user_id FROM events")
def message_order(spark: SparkSession, folder: str) -> DataFrame:
    """Listing by several columns."""
    e = read_table(spark, folder, "events", ["event_id", "user_id", "ts"])
    return runlog.in_order(e, "user_id", "ts", "event_id").select("event_id", "user_id")


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 5 IN (0, 1) THEN o_custkey END AS rows_imported,
CASE WHEN o_orderstatus = 'F' OR o_orderkey % 5 = 0 THEN 'a,b' ELSE '' END AS tables FROM orders""")
def load_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of import jobs: good, without tables, mistyped, broken, missing, and corrected by a later line."""
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    k, rows = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    whole = F.concat(F.lit(' {"rows_imported": '), rows, F.lit(', "tables": ["a", "b"]}'))
    report = (
        F.when(k % 5 == 0, whole)
        .when(k % 5 == 1, F.concat(F.lit('{"rows_imported": '), rows, F.lit("}")))
        .when(k % 5 == 2, F.concat(F.lit('{"rows_imported": "'), rows, F.lit('", "tables": ["a"]}')))
        .when(k % 5 == 3, F.concat(F.lit('{"rows_imported": '), rows, F.lit(', "tables": ')))
        .otherwise(F.lit("done"))
    )
    lines = F.array(F.lit("reading"), report, F.when(F.col("o_orderstatus") == "F", whole).otherwise("bye"))
    output = o.select(k.alias("run_id"), F.posexplode(lines).alias("line_no", "line"))
    out = runlog.load_reports(output)
    return out.select("run_id", "rows_imported", F.concat_ws(",", "tables").alias("tables"))
