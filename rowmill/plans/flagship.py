"""Flagship job over the flat sales: evidence, split and validation in one result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators.profile import union_all
from rowmill.operators.validate import key_violations, orphan_report, table_checks
from rowmill.operators.normalize import multiset_difference, rebuild
from rowmill.plans.importer import split_flat
from rowmill.plans.views import flat_file
from rowmill.session import configure


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """``check, subject, value``: rows per split table, key violations, orphans and lost rows."""
    configure(spark)
    flat = flat_file(spark, folder)
    tables, foreign = split_flat(flat, "sales")
    rows = [table_checks(tables).select(F.lit("rows").alias("check"), F.col("table").alias("subject"), F.col("row_count").alias("value"))]
    for _, _, parent, key in foreign:
        bad = key_violations(tables[parent], [key]).agg(F.count(F.lit(1)).alias("value"))
        rows.append(bad.select(F.lit("key violations").alias("check"), F.lit(f"{parent}.{key}").alias("subject"), "value"))
    orphans = orphan_report(tables, foreign)
    rows.append(
        orphans.select(
            F.lit("orphans").alias("check"), F.concat_ws(".", "table", "column").alias("subject"), F.col("orphan_rows").alias("value")
        )
    )
    again = rebuild(tables["sales"], [(tables[p], k) for _, _, p, k in foreign], flat.columns)
    lost = multiset_difference(flat, again).agg(F.count(F.lit(1)).alias("value"))
    rows.append(lost.select(F.lit("lost rows").alias("check"), F.lit("sales").alias("subject"), "value"))
    return union_all(rows)
