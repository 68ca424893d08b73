"""Catalogue of stored tables: schemas, constraints, counts and keyed upserts.

Constraints are rows ``(table, column, pos, kind, ref_table, ref_column)`` with kind pk, fk or
not_null, because plain parquet tables keep none.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.errors import IntakeError
from rowmill.operators.infer import sql_type
from rowmill.operators.profile import union_all
from rowmill.operators.ranking import first_per_group

CONSTRAINTS = "table string, column string, pos int, kind string, ref_table string, ref_column string"
COLUMNS = "table string, column string, pos int, type string"


def constraints(
    spark: SparkSession,
    primary: Mapping[str, Sequence[str]] | None = None,
    foreign: Iterable[tuple[str, str, str, str]] = (),
    not_null: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Constraint rows; key columns are also NOT NULL."""
    rows = []
    for table, cols in (primary or {}).items():
        rows += [(table, c, i, "pk", None, None) for i, c in enumerate(cols)]
        rows += [(table, c, i, "not_null", None, None) for i, c in enumerate(cols)]
    rows += [(t, c, 0, "fk", rt, rc) for t, c, rt, rc in foreign]
    for table, cols in (not_null or {}).items():
        rows += [(table, c, 0, "not_null", None, None) for c in cols if c not in (primary or {}).get(table, ())]
    return spark.createDataFrame(rows, CONSTRAINTS)


def column_rows(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Schema rows of the tables."""
    rows = [(t, c, i, sql_type(d)) for t, df in tables.items() for i, (c, d) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, COLUMNS)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table, row_count`` of every table in one job."""
    return union_all([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table"), "row_count")
                      for t, df in tables.items()])


def table_list(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table, row_count, column_count`` by name."""
    frames = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(t).alias("table"), "row_count", F.lit(len(df.columns)).alias("column_count")
        )
        for t, df in tables.items()
    ]
    return union_all(frames).orderBy("table")


def table_detail(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """``table, pos, column, type, nullable, is_pk, ref_table, ref_column``, several tables at once."""
    flags = rules.groupBy("table", "column").agg(
        F.max(F.col("kind") == "pk").alias("is_pk"),
        F.max(F.col("kind").isin("pk", "not_null")).alias("required"),
        F.max(F.when(F.col("kind") == "fk", F.col("ref_table"))).alias("ref_table"),
        F.max(F.when(F.col("kind") == "fk", F.col("ref_column"))).alias("ref_column"),
    )
    joined = columns.join(flags, ["table", "column"], "left")
    return joined.select(
        "table",
        "pos",
        "column",
        "type",
        (~F.coalesce("required", F.lit(False))).alias("nullable"),
        F.coalesce("is_pk", F.lit(False)).alias("is_pk"),
        "ref_table",
        "ref_column",
    )


def schema_view(spark: SparkSession, tables: Mapping[str, DataFrame], rules: DataFrame) -> DataFrame:
    """Detail of every table with its row count; stored tables are not editable in place."""
    detail = table_detail(column_rows(spark, tables), rules)
    return detail.join(row_counts(tables), "table").withColumn("editable", F.lit(False))


def fk_edges(rules: DataFrame) -> DataFrame:
    """``src_table, src_column, dst_table, dst_column`` per foreign key."""
    return rules.filter("kind = 'fk'").select(
        F.col("table").alias("src_table"),
        F.col("column").alias("src_column"),
        F.col("ref_table").alias("dst_table"),
        F.col("ref_column").alias("dst_column"),
    )


def load_order(names: Iterable[str], rules: DataFrame) -> list[str]:
    """Tables with parents before children; tables in a cycle come last by name."""
    left = sorted(names)
    edges = {(r["src_table"], r["dst_table"]) for r in fk_edges(rules).collect() if r["src_table"] != r["dst_table"]}
    out: list[str] = []
    while left:
        ready = [t for t in left if not any(s == t and d in left for s, d in edges)] or left[:]
        out += ready
        left = [t for t in left if t not in ready]
    return out


def _refuse_repeats(updates: DataFrame, keys: Sequence[str]) -> None:
    named = [F.col(f"`{k}`") for k in keys]
    repeated = updates.groupBy(*named).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*named).take(1)
    if repeated:
        values = ", ".join(f"{k} = {v!r}" for k, v in zip(keys, repeated[0], strict=True))
        raise IntakeError(f"the updates send a key more than once: {values}")


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    keep_first: Sequence[str] = (),
    partial: bool = False,
    clear: Mapping[str, Column] | None = None,
    guard: str | None = None,
    latest: Sequence[Column] = (),
) -> DataFrame:
    """Insert or overwrite rows by key; the stored rows are unique on ``keys``.

    Updates that send a key twice are refused (``IntakeError``), as the order in which they count is not known; with
    ``latest`` the one that is last in this order counts, ties going by all its columns.

    ``keep_first`` columns keep the stored value once set. With ``partial`` a NULL in the update leaves
    the stored value. ``clear`` names columns set to NULL where its condition on the update (columns
    prefixed ``new_``) holds. ``guard`` is a condition on the stored row (prefixed ``old_``); where it
    fails the stored row stays as it is.
    """
    if latest:
        order = [c.desc_nulls_last() for c in (*latest, *(F.col(f"`{c}`") for c in updates.columns))]
        updates = first_per_group(updates, keys, order)
    else:
        _refuse_repeats(updates, keys)
    cols = target.columns
    a = target.select(*[F.col(f"`{c}`").alias(f"old_{c}") for c in cols], F.lit(True).alias("_stored"))
    b = updates.select(*[F.col(f"`{c}`").alias(f"new_{c}") for c in updates.columns], F.lit(True).alias("_sent"))
    same = None
    for k in keys:
        one = F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}"))
        same = one if same is None else same & one
    joined = a.join(b, same, "full_outer")
    stored, sent = F.coalesce("_stored", F.lit(False)), F.coalesce("_sent", F.lit(False))
    allowed = sent & (~stored | F.coalesce(F.expr(guard), F.lit(False))) if guard else sent
    out = []
    for c in cols:
        old = F.col(f"old_{c}")
        if c not in updates.columns:
            out.append(old.alias(c))
            continue
        new = F.col(f"new_{c}")
        if c in keys:
            out.append(F.when(stored, old).otherwise(new).alias(c))
            continue
        merged = new
        if c in keep_first:
            merged = F.coalesce(old, new)
        elif partial:
            merged = F.coalesce(new, old)
        if clear and c in clear:
            merged = F.when(F.coalesce(clear[c], F.lit(False)), F.lit(None)).otherwise(merged)
        out.append(F.when(allowed, merged).otherwise(old).alias(c))
    return joined.select(*out)
