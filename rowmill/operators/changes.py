"""Data changes: a change maps a table's frame to a new frame and is previewed before it is applied."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.errors import Conflict
from rowmill.functions.convert import rendered
from rowmill.operators.catalog import upsert
from rowmill.operators.clean import Converter, try_convert
from rowmill.operators.versions import VersionStore

KINDS = ("update", "delete", "insert", "merge", "add_column", "drop_column", "rename_column", "retype")
COUNTED = ("update", "delete", "insert", "merge")


def _expr(e: str | Column) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def _holds(where: str | Column) -> Column:
    return F.coalesce(_expr(where), F.lit(False))


def update(df: DataFrame, where: str | Column, values: Mapping[str, str | Column]) -> DataFrame:
    """Set columns on the rows where the predicate holds."""
    hit = _holds(where)
    return df.withColumns(
        {c: F.when(hit, _expr(e).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")) for c, e in values.items()}
    )


def delete(df: DataFrame, where: str | Column) -> DataFrame:
    """Drop the rows where the predicate holds; an unknown predicate keeps the row."""
    return df.filter(~_holds(where))


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Add rows; columns they lack become NULL."""
    return df.unionByName(rows, allowMissingColumns=True)


def merge(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overwrite rows with a matching key, add the others."""
    return upsert(df, rows, keys)


def retype(df: DataFrame, column: str, target: str | Converter) -> DataFrame:
    """Convert a column in one projection; cells that do not fit become NULL (see ``cast_rejects``)."""
    return try_convert(df, {column: target})


@dataclass(frozen=True)
class Change:
    """One proposed change of one table."""

    table: str
    kind: str
    where: str | None = None
    values: Mapping[str, str] = field(default_factory=dict)
    rows: DataFrame | None = None
    keys: Sequence[str] = ()
    summary: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """The changed frame; nothing is written."""
        if self.kind == "update":
            return update(df, self.where or "true", self.values)
        if self.kind == "delete":
            return delete(df, self.where or "true")
        if self.kind == "insert":
            return insert(df, self.rows)
        if self.kind == "merge":
            return merge(df, self.rows, self.keys)
        if self.kind == "add_column":
            return df.withColumns({c: _expr(e) for c, e in self.values.items()})
        if self.kind == "drop_column":
            return df.drop(*self.values)
        if self.kind == "rename_column":
            return df.withColumnsRenamed(dict(self.values))
        if self.kind == "retype":
            return try_convert(df, dict(self.values))
        raise Conflict(f"unknown kind of change {self.kind!r}")

    def dry_run(self, df: DataFrame, estimate: int | None = None) -> DataFrame:
        """One row ``affected_rows, total_rows`` without keeping the change.

        Matched rows count, equal values included; changes of the schema have no count.
        """
        total = F.count(F.lit(1)).alias("total_rows")
        if self.kind in ("update", "delete"):
            return df.agg(F.count_if(_holds(self.where or "true")).alias("affected_rows"), total)
        if self.kind in ("insert", "merge"):
            n = self.rows.agg(F.count(F.lit(1)).alias("n")).scalar()
            return df.agg(total).select(n.alias("affected_rows"), "total_rows")
        return df.agg(total).select(F.lit(estimate).cast("long").alias("affected_rows"), "total_rows")


def row_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, change`` for rows inserted, updated or deleted between two versions."""
    shared = [c for c in before.columns if c in after.columns and c not in keys]

    def side(df: DataFrame, tag: str) -> DataFrame:
        values = [F.col(f"`{c}`").alias(f"{tag}_{c}") for c in shared]
        return df.select(*[f"`{k}`" for k in keys], F.lit(1).alias(f"_{tag}"), *values)

    joined = side(before, "b").join(side(after, "a"), list(keys), "full_outer")
    differs = F.lit(False)
    for c in shared:
        differs = differs | ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    change = F.when(F.col("_b").isNull(), "insert").when(F.col("_a").isNull(), "delete").when(differs, "update")
    return joined.select(*keys, change.alias("change")).filter("change IS NOT NULL")


def cell_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, column, before, after`` (as text) for every changed cell of a kept row."""
    types = dict(before.dtypes)
    shared = [c for c in before.columns if c in after.columns and c not in keys]
    a = before.select(*keys, *[F.col(f"`{c}`").alias(f"b_{c}") for c in shared])
    b = after.select(*keys, *[F.col(f"`{c}`").alias(f"a_{c}") for c in shared])
    joined = a.join(b, list(keys))
    cells = []
    for c in shared:
        old, new = F.col(f"b_{c}"), F.col(f"a_{c}")
        cell = F.struct(
            F.lit(c).alias("column"),
            rendered(old, types[c]).cast("string").alias("before"),
            rendered(new, dict(after.dtypes)[c]).cast("string").alias("after"),
        )
        cells.append(F.when(~old.eqNullSafe(new), cell))
    return joined.select(*keys, F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))


def preview(before: DataFrame, change: Change, keys: Sequence[str], examples: int = 4) -> DataFrame:
    """A few ``column, before, after`` examples in key order.

    An update is previewed on the matching rows alone, so the table is not joined with itself.
    """
    if change.kind == "update":
        types = dict(before.dtypes)
        hit = before.filter(_holds(change.where or "true"))
        cells = []
        for c, e in change.values.items():
            new = _expr(e).cast(before.schema[c].dataType)
            cell = F.struct(
                F.lit(c).alias("column"),
                rendered(F.col(f"`{c}`"), types[c]).cast("string").alias("before"),
                rendered(new, types[c]).cast("string").alias("after"),
            )
            cells.append(F.when(~F.col(f"`{c}`").eqNullSafe(new), cell))
        found = hit.select(*keys, F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))
    else:
        found = cell_diff(before, change.apply(before), keys)
    return found.orderBy(*keys, "column").limit(examples)


_LOG = (
    "change_id string, seq long, table string, kind string, summary string, status string, "
    "affected_rows long, total_rows long, snapshot long"
)


class ChangeBook:
    """Life cycle of a project's changes: proposing, then applied, rejected or failed; applied may revert.

    The log is append-only; the newest row of a change is its state. Only the latest applied change
    can be undone.
    """

    def __init__(self, store: VersionStore) -> None:
        self.store = store
        self.path = f"{store.root}/changes"
        self._open: dict[str, Change] = {}

    def log(self) -> DataFrame:
        try:
            return self.store.spark.read.schema(_LOG).parquet(self.path)
        except AnalysisException:
            return self.store.spark.createDataFrame([], _LOG)

    def current(self) -> DataFrame:
        """Newest row of every change."""
        log = self.log()
        newest = log.groupBy("change_id").agg(F.max_by(F.struct(*log.columns[1:]), "seq").alias("r"))
        return newest.select("change_id", "r.*")

    def _write(self, **row: object) -> None:
        row["seq"] = time.time_ns()
        names = [field.split()[0] for field in _LOG.split(", ")]
        out = self.store.spark.createDataFrame([tuple(row.get(c) for c in names)], _LOG)
        out.coalesce(1).write.mode("append").parquet(self.path)

    def _state(self, change_id: str, *expected: str) -> tuple[dict, list[dict]]:
        """The change in one of the expected states, and the changes that hold a snapshot."""
        holds = F.col("snapshot").isNotNull() & (F.col("status") == "applied")
        rows = [r.asDict() for r in self.current().filter((F.col("change_id") == change_id) | holds).collect()]
        mine = [r for r in rows if r["change_id"] == change_id]
        if not mine:
            raise Conflict(f"unknown change {change_id!r}")
        if mine[0]["status"] not in expected:
            raise Conflict(f"change is already {mine[0]['status']}")
        return mine[0], [r for r in rows if r["change_id"] != change_id]

    def propose(self, change: Change, estimate: int | None = None) -> str:
        counts = change.dry_run(self.store.read(change.table), estimate).first()
        change_id = uuid.uuid4().hex
        self._open[change_id] = change
        self._write(
            change_id=change_id,
            table=change.table,
            kind=change.kind,
            summary=change.summary,
            status="proposing",
            affected_rows=counts["affected_rows"],
            total_rows=counts["total_rows"],
        )
        return change_id

    def apply(self, change_id: str) -> int | None:
        """Write the changed table as a new version; a failure leaves the data as it was."""
        state, holders = self._state(change_id, "proposing")
        change = self._open[change_id]
        before = self.store.read(change.table)
        snapshot = self.store.snapshot()
        try:
            staged = self.store.stage({change.table: change.apply(before)})
        except Exception:
            self.store.drop_snapshot(snapshot)
            self._write(**{**state, "status": "failed", "snapshot": None})
            raise
        self.store.publish(staged)
        self._write(**{**state, "status": "applied", "snapshot": snapshot})
        for old in holders:
            self.store.drop_snapshot(old["snapshot"])
            self._write(**{**old, "snapshot": None})
        return state["affected_rows"] if change.kind in COUNTED else None

    def undo(self, change_id: str) -> None:
        state, _ = self._state(change_id, "applied")
        if state["snapshot"] is None:
            raise Conflict("only the most recently applied change can be undone")
        self.store.restore(state["snapshot"])
        self._write(**{**state, "status": "reverted", "snapshot": None})

    def reject(self, change_id: str) -> None:
        state, _ = self._state(change_id, "proposing")
        self._write(**{**state, "status": "rejected"})
