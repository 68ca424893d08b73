"""Row numbers that survive a hot group.

A window over a group holding a third of the rows sorts that third in one task. Rows are range
partitioned by (group, order) instead, so that a group spreads over as many tasks as it needs, and each
task's position is turned into the final number by adding the group's row count in earlier tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rowmill.session import materialize

# monotonically_increasing_id keeps the row's position in the low 33 bits.
_POSITION_BITS = (1 << 33) - 1


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` plus a dense 1-based ``name`` per group in ``order`` (ascending, NULL first).

    ``order`` must identify a row within its group. Without a group the whole frame is one sequence.
    """
    return _by_range(df, group, order, name)


def _by_range(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """The numbered layout is written once, so that a lost executor cannot renumber rows."""
    keys = [*group, *order]
    laid_out = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid_out = laid_out.select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)).alias("_pos"),
    )
    stored = materialize(laid_out, "numbered")
    marks = stored.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    # One row per task a group touches, so this window stays small even for the hottest group.
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    if not group:
        earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    marks = marks.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    marks = marks.select(*[F.col(k).alias(f"_m_{k}") for k in ["_part", *group]], "_first", "_base")
    same: list[Column] = [stored[k].eqNullSafe(marks[f"_m_{k}"]) for k in ["_part", *group]]
    joined = stored.join(marks, reduce(Column.__and__, same))
    number = (F.col("_pos") - F.col("_first") + F.col("_base") + 1).alias(name)
    return joined.select(*[F.col(c) for c in df.columns], number)


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], count: int = 1) -> DataFrame:
    """The first ``count`` rows of each group; each task forwards at most ``count`` rows per group."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= count).drop("_rank")
