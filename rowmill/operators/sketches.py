"""Profiles that add up: per load and column counts and a distinct-count sketch, so that an append profiles only its own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators.profile import long_cells, rate

# Base-2 log of the sketch's registers: the standard error of a count is 1.04 / sqrt(2 ** LOG_SIZE), 0.8 %.
LOG_SIZE = 14
STORED = "load string, pos int, column string, row_count bigint, filled bigint, sketch binary"


def load_profile(df: DataFrame, load: str) -> DataFrame:
    """The rows of ``STORED`` for one load: one scan, one row per column and task in the shuffle."""
    ids, cells = long_cells({"": df}, counted=True)
    value = F.xxhash64("as_long", "as_double", F.coalesce("as_text", F.lit("")))
    # The constant cell of each row only counts; it needs no sketch of its own, but a group has one.
    found = cells.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(value, LOG_SIZE).alias("sketch"))
    spark = df.sparkSession
    layout = spark.createDataFrame([(i, c) for i, (_, c) in enumerate(ids)], "pos int, column string")
    rows = found.where("cid < 0").select(F.col("n").alias("rows"))
    held = found.where("cid >= 0").select(F.col("cid").alias("pos"), F.col("n").alias("held"), "sketch")
    out = layout.join(held, "pos", "left").join(F.broadcast(rows.agg(F.max("rows").alias("rows"))))
    return out.select(
        F.lit(load).alias("load"), "pos", "column", F.coalesce("rows", F.lit(0)).alias("row_count"),
        F.coalesce("held", F.lit(0)).alias("filled"), "sketch",
    )


def add_load(spark: SparkSession, folder: str, df: DataFrame, load: str) -> None:
    """Store the profile of a load; the same load stored again replaces itself."""
    load_profile(df, load).drop("load").coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/load={load}")


def stored_loads(spark: SparkSession, folder: str) -> DataFrame:
    """All loads stored under a folder."""
    return spark.read.schema(STORED).parquet(folder)


def merged_profile(loads: DataFrame) -> DataFrame:
    """``pos, column, row_count, null_rate, distinct_estimate`` over all loads.

    Columns are matched by name; one that a load lacks is a gap in all its rows. Counts are exact, distinct values (NULL
    not counted) are estimated from the union of the sketches. ``pos`` is the first place a column had.
    """
    rows = loads.groupBy("load").agg(F.max("row_count").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    columns = loads.groupBy("column").agg(
        F.min("pos").alias("pos"), F.sum("filled").alias("filled"), F.hll_union_agg("sketch").alias("sketch")
    )
    out = columns.withColumn("row_count", rows.scalar())
    return out.select(
        "pos", "column", "row_count", rate(F.col("row_count") - F.col("filled"), F.col("row_count")).alias("null_rate"),
        F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("bigint").alias("distinct_estimate"),
    )
