"""Import-run logs: listings, state changes, retention, cascading undo, step histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.operators.catalog import upsert
from rowmill.operators.ranking import first_per_group, numbered

# Run states and the canonical steps.
ACTIVE = (
    "profiling", "generating", "executing", "fixing", "validating",
    "cancelling", "needs_clarification", "awaiting_schema_approval",
)
FINAL = ("completed", "failed", "cancelled", "reverted")
RELEASED = ("failed", "cancelled", "reverted")
STEPS = ("profile", "propose_schema", "generate", "execute", "validate")
INTERRUPTED = "The run was still going when its worker stopped."
KEEP_LAST = 10
MAX_AGE_DAYS = 30

# Attempts (or iterations) per part of a run record; a normal run fits in one part.


# -- listings ------------------------------------------------------------------------------------


def enriched_runs(runs: DataFrame, documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Runs with their document and project columns."""
    return runs.join(documents, "document_id").join(projects, "project_id")


def project_stats(projects: DataFrame, documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Projects with document and completed-import counts, 0 where there are none."""
    d = documents.groupBy("project_id").agg(F.count(F.lit(1)).alias("docs_count"))
    r = runs.filter("status = 'completed'").groupBy("project_id").agg(F.count(F.lit(1)).alias("completed_imports"))
    return projects.join(d, "project_id", "left").join(r, "project_id", "left").fillna(
        0, ["docs_count", "completed_imports"]
    )


def deletable_documents(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents without a run that is unfinished or completed."""
    blockers = runs.filter(~F.col("status").isin(*RELEASED)).select("document_id").distinct()
    return documents.join(blockers, "document_id", "left_anti")


def attach_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with their optional parent's columns (messages with their change)."""
    return children.join(parents, key, "left")


def newest_first(df: DataFrame, *columns: str) -> DataFrame:
    """Newest first with missing times last."""
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in columns])


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Oldest first by several columns (messages by time, then id)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def latest_per_group(df: DataFrame, group: str, order: str) -> DataFrame:
    """The newest row of each group (proposal of a run, change of a project)."""
    others = [c for c in df.columns if c != group]
    newest = df.groupBy(group).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return newest.select(*[F.col("_r")[c].alias(c) if c != group else F.col(c) for c in df.columns])


def with_undo_flag(runs: DataFrame) -> DataFrame:
    """Runs with ``undo_available``: completed and still holding a snapshot."""
    return runs.withColumn("undo_available", (F.col("status") == "completed") & F.col("snapshot").isNotNull())


# -- state changes -------------------------------------------------------------------------------


def set_status(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Partial update by ``run_id``: fields sent as NULL stay; ``clear_snapshot`` empties the snapshot."""
    clear = {"snapshot": F.col("new_clear_snapshot")} if "clear_snapshot" in updates.columns else None
    shown = updates
    for c in runs.columns:
        if c not in shown.columns and clear and c == "snapshot":
            shown = shown.withColumn("snapshot", F.lit(None).cast("string"))
    return upsert(runs, shown, ["run_id"], partial=True, clear=clear)


def upsert_steps(steps: DataFrame, updates: DataFrame) -> DataFrame:
    """Steps by (run, step, attempt): first start and title are kept, the rest is overwritten."""
    return upsert(steps, updates, ["run_id", "step", "attempt"], keep_first=["started_at", "title"])


def answer(questions: DataFrame, answers: DataFrame, key: str = "question_id") -> DataFrame:
    """Record answers; an answered question does not change any more."""
    return upsert(questions, answers, [key], partial=True, guard="old_answered_at IS NULL")


def recover_interrupted(runs: DataFrame, as_of: Column) -> DataFrame:
    """After a restart: active runs become cancelled if that was requested, else failed."""
    active = F.col("status").isin(*ACTIVE)
    return runs.withColumns(
        {
            "status": F.when(active, F.when(F.col("cancel_requested"), "cancelled").otherwise("failed")).otherwise(
                F.col("status")
            ),
            "finished_at": F.when(active, F.coalesce("finished_at", as_of)).otherwise(F.col("finished_at")),
            "error_message": F.when(active, F.coalesce("error_message", F.lit(INTERRUPTED))).otherwise(
                F.col("error_message")
            ),
            "snapshot": F.when(active, F.lit(None)).otherwise(F.col("snapshot")),
        }
    )


def toggle_pin(runs: DataFrame, run_ids: DataFrame) -> DataFrame:
    """Flip the pin of the named runs that hold a snapshot."""
    hit = run_ids.select("run_id", F.lit(True).alias("_hit")).distinct()
    flip = F.coalesce("_hit", F.lit(False)) & F.col("snapshot").isNotNull()
    joined = runs.join(hit, "run_id", "left")
    return joined.withColumn("pinned", F.when(flip, ~F.col("pinned")).otherwise(F.col("pinned"))).drop("_hit")


# -- retention -----------------------------------------------------------------------------------


def _expirable(runs: DataFrame) -> DataFrame:
    return runs.filter((F.col("status") == "completed") & ~F.col("pinned") & F.col("snapshot").isNotNull())


def expired_by_count(runs: DataFrame, keep: int = KEEP_LAST) -> DataFrame:
    """Unpinned completed runs beyond the newest ``keep`` of their project.

    The rows to keep are ranked, not the rows to drop: a rank limit lets every task forward ``keep``
    rows per project, so a project holding a third of the log is never sorted in one task.
    """
    held = _expirable(runs)
    order = [F.col("finished_at").desc_nulls_last(), F.col("started_at").desc(), F.col("run_id").asc()]
    kept = first_per_group(held.select("run_id", "project_id", "finished_at", "started_at"), ["project_id"], order, keep)
    return held.join(kept.select("run_id"), "run_id", "left_anti")


def expired_by_age(runs: DataFrame, as_of: Column, days: int = MAX_AGE_DAYS) -> DataFrame:
    """Unpinned completed runs that finished more than ``days`` ago; 0 turns the rule off."""
    if days <= 0:
        return _expirable(runs).limit(0)
    return _expirable(runs).filter(F.col("finished_at") < as_of - F.make_interval(days=F.lit(days)))


def snapshot_list(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs holding a snapshot with its size, newest first."""
    held = runs.filter(F.col("snapshot").isNotNull()).join(sizes, "snapshot", "left")
    rows = held.select(
        "run_id", "snapshot", "finished_at", "pinned", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "started_at"
    )
    ordered = rows.orderBy(F.col("finished_at").desc_nulls_last(), F.col("started_at").desc(), "run_id")
    return ordered.drop("started_at")


# -- undo ----------------------------------------------------------------------------------------


def later_runs(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """Completed or failed runs of the target's project that started after it.

    ``targets`` has at most one row ``project_id, target_id, target_started`` per project, so the join
    only widens ``runs``.
    """
    settled = runs.filter(F.col("status").isin("completed", "failed"))
    return settled.join(targets, "project_id").filter("started_at > target_started")


def undo(runs: DataFrame, targets: DataFrame, as_of: Column) -> DataFrame:
    """Runs after undoing one run per project, with everything that project did since.

    ``targets`` has ``run_id``; only completed runs with a snapshot can be undone. If several runs of
    a project are named, the earliest stands for all.
    """
    undoable = runs.filter((F.col("status") == "completed") & F.col("snapshot").isNotNull())
    wanted = undoable.join(targets.select("run_id").distinct(), "run_id", "left_semi")
    firsts = wanted.groupBy("project_id").agg(
        F.min(F.struct("started_at", "run_id")).alias("_t")
    ).select(
        "project_id", F.col("_t.run_id").alias("target_id"), F.col("_t.started_at").alias("target_started")
    )
    joined = runs.join(firsts, "project_id", "left")
    itself = F.col("run_id") == F.col("target_id")
    later = F.col("status").isin("completed", "failed") & (F.col("started_at") > F.col("target_started"))
    hit = F.coalesce(itself | later, F.lit(False))
    return joined.select(
        *[
            F.when(hit, F.lit("reverted")).otherwise(F.col("status")).alias("status")
            if c == "status"
            else F.when(hit, F.lit(None)).otherwise(F.col("snapshot")).alias("snapshot")
            if c == "snapshot"
            else F.col(c)
            for c in runs.columns
        ],
        F.when(hit, as_of).alias("reverted_at"),
        F.when(hit & ~F.coalesce(itself, F.lit(False)), F.col("target_id")).alias("reverted_by_run_id"),
    )


def without_project(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Log rows left after deleting projects; ``gone`` has ``project_id``."""
    return df.join(gone.select("project_id"), "project_id", "left_anti")


def delete_projects(
    projects: DataFrame, runs: DataFrame, of_project: dict[str, DataFrame], of_run: dict[str, DataFrame], gone: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """All that is left after deleting projects, and the snapshots to drop.

    ``gone`` has ``project_id``. ``of_project`` and ``of_run`` are the tables that hang on projects and on runs; the rows of
    the deleted ones go with them. The second frame, ``project_id, run_id, snapshot``, names what runs of these projects
    had stored.
    """
    ended = runs.join(gone.select("project_id").distinct(), "project_id", "left_semi")
    left = {"projects": without_project(projects, gone), "runs": without_project(runs, gone)}
    left |= {name: without_project(df, gone) for name, df in of_project.items()}
    left |= {name: df.join(ended.select("run_id"), "run_id", "left_anti") for name, df in of_run.items()}
    return left, ended.where("snapshot IS NOT NULL").select("project_id", "run_id", "snapshot")


# -- steps ---------------------------------------------------------------------------------------


def number_attempts(steps: DataFrame, order: Sequence[str]) -> DataFrame:
    """``attempt`` per (run, step) in start order."""
    return numbered(steps, ["run_id", "step"], order, "attempt")


def _step_index() -> Column:
    index = F.lit(len(STEPS))
    for i, name in enumerate(STEPS):
        index = F.when(F.col("step") == name, F.lit(i)).otherwise(index)
    return index


def canonical_steps(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """All received steps with ``step_no``, plus a pending row for each canonical step a run lacks.

    The received rows do not move: only the distinct (run, step) pairs are compared with what is due.
    """
    due = runs.select("run_id", F.explode(F.array(*[F.lit(s) for s in STEPS])).alias("step"))
    missing = due.join(steps.select("run_id", "step").distinct(), ["run_id", "step"], "left_anti")
    missing = missing.withColumns({"attempt": F.lit(1), "status": F.lit("pending")})
    return steps.unionByName(missing, allowMissingColumns=True).withColumn("step_no", _step_index())


def step_durations(steps: DataFrame) -> DataFrame:
    """Steps with ``duration_ms`` from start and finish."""
    ms = F.expr("timestampdiff(MILLISECOND, started_at, finished_at)")
    return steps.withColumn("duration_ms", ms)


def fix_statistics(steps: DataFrame) -> DataFrame:
    """``run_id, attempts, steps, failed_steps`` per run."""
    return steps.groupBy("run_id").agg(
        F.max("attempt").alias("attempts"),
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("status") == "error").alias("failed_steps"),
    )


def auto_decisions(questions: DataFrame) -> DataFrame:
    """``run_id, questions, auto_decided`` per run."""
    return questions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("auto_decision").alias("auto_decided")
    )


def run_records(runs: DataFrame, steps: DataFrame, questions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Everything recorded of each run, one row per item: the columns of ``runs``, then ``kind, no, attempt, item``.

    ``kind`` is step (``no`` is its place in the flow), question (``question_no``) or proposal (``iteration``);
    ``item`` holds the other columns of the item's table as JSON. Runs without any item have one row without a kind. A run
    with endless attempts is just more rows; nothing is nested and nothing cut.
    """

    def items(df: DataFrame, kind: str, no: Column, attempt: Column, used: Sequence[str]) -> DataFrame:
        rest = [F.col(f"`{c}`") for c in df.columns if c not in ("run_id", *used)]
        text = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
        return df.select("run_id", F.lit(kind).alias("kind"), no.cast("long").alias("no"), attempt.cast("long").alias("attempt"), text.alias("item"))

    once = F.lit(None)
    every = items(steps, "step", _step_index(), F.col("attempt"), ["attempt"])
    every = every.unionByName(items(questions, "question", F.col("question_no"), once, ["question_no"]))
    every = every.unionByName(items(proposals, "proposal", F.col("iteration"), once, ["iteration"]))
    return runs.join(every, "run_id", "left")


def load_reports(output: DataFrame) -> DataFrame:
    """``run_id, rows_imported, tables`` from the output lines ``run_id, line_no, line`` of import jobs.

    The last line that starts like a JSON object is the report. Without one, or when it is not an
    object with a whole ``rows_imported`` and (if given) a list ``tables``, nothing counts as reported.
    """
    text = F.trim("line")
    last = output.groupBy("run_id").agg(F.max_by(F.when(text.startswith("{"), text), F.when(text.startswith("{"), F.col("line_no"))).alias("r"))
    parsed = last.select("run_id", F.try_parse_json("r").alias("v"))
    rows, tables = F.try_variant_get("v", "$.rows_imported", "variant"), F.try_variant_get("v", "$.tables", "variant")
    # Missing, null, false, zero and empty lists of tables all read as "no tables".
    kind = F.coalesce(F.schema_of_variant(tables), F.lit("VOID"))
    listed = kind.startswith("ARRAY")
    nothing = (kind == "VOID") | tables.cast("string").isin("", "0", "false")
    good = F.coalesce((F.schema_of_variant(rows) == "BIGINT") & (listed | nothing), F.lit(False))
    none = F.array().cast("array<string>")
    return parsed.select(
        "run_id",
        F.when(good, F.try_variant_get("v", "$.rows_imported", "long")).alias("rows_imported"),
        F.when(good & listed, F.try_variant_get("v", "$.tables", "array<string>")).otherwise(none).alias("tables"),
    )
