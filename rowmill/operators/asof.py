"""As-of join: latest reference row at or before a point in time, per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rowmill.session import materialize


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_at: str,
    right_at: str,
    values: Sequence[str],
    bucket: str | None = None,
) -> DataFrame:
    """``left`` plus ``values`` of the latest ``right`` row per ``by`` with ``right_at <= left_at``.

    Rows of ``left`` without an earlier match keep NULL. ``by`` columns share their names.

    The answer depends only on (by, time), so the distinct probes of ``left`` are merged with ``right``; repetition
    collapses on the map side and a key with a third of the rows costs no more than its distinct times. The merged
    rows are range partitioned by (by, time), so a key spreads over as many tasks as its times need, however fine they
    are. A summary with a row per key and task tells the last value before each task, which is carried in; no task
    sorts a key's whole history. The answers then go back to ``left`` by equality. ``bucket`` named the time slots of
    an earlier split and has no effect any more.
    """
    at, part, side = "_at", "_part", "_side"
    probes = left.select(*by, F.col(left_at).cast("timestamp").alias(at)).filter(F.col(at).isNotNull()).distinct()
    value = F.struct(*[F.col(v) for v in values])
    quotes = right.select(*by, F.col(right_at).cast("timestamp").alias(at), value.alias("_v")).filter(
        F.col(at).isNotNull()
    )
    empty = F.lit(None).cast(quotes.schema["_v"].dataType)
    # Side 0 sorts reference rows before probes of the same instant.
    merged = quotes.select(*by, at, F.lit(0).alias(side), "_v").unionByName(probes.select(*by, at, F.lit(1).alias(side), empty.alias("_v")))
    # Written once, so that a lost executor cannot deal the rows anew.
    dealt = materialize(merged.repartitionByRange(*by, at, side).withColumn(part, F.spark_partition_id()), "asof")
    newest = F.max_by("_v", F.when(F.col(side) == 0, F.col(at))).alias("_last")
    held = dealt.groupBy(*by, part).agg(newest)
    before = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    carried = held.select(*by, part, F.last("_last", ignorenulls=True).over(before).alias("_v")).filter(F.col("_v").isNotNull())
    rows = dealt.unionByName(carried.select(*by, F.lit(None).cast("timestamp").alias(at), F.lit(-1).alias(side), "_v", part))
    # What is carried in comes first; a group is a key's rows in one task's range.
    upto = W.partitionBy(*by, part).orderBy(F.col(at).asc_nulls_first(), side).rowsBetween(W.unboundedPreceding, W.currentRow)
    answered = rows.withColumn("_r", F.last("_v", ignorenulls=True).over(upto)).filter(F.col(side) == 1)
    answers = answered.select(
        *[F.col(b).alias(f"_b_{b}") for b in by], F.col(at).alias("_b_at"), *[F.col("_r")[v].alias(v) for v in values]
    )
    same = F.col(left_at).cast("timestamp") == F.col("_b_at")
    for b in by:
        same = same & (left[b] == F.col(f"_b_{b}"))
    return left.join(answers, same, "left").drop("_b_at", *[f"_b_{b}" for b in by])


def convert_currency(
    df: DataFrame, rates: DataFrame, amount: str, currency: str, at: str, name: str, base: str = "USD"
) -> DataFrame:
    """``name``: the amount in the base currency at the rate valid on ``at``, and that ``rate``.

    ``rates`` has ``currency``, ``day`` and ``rate``; the base itself needs no rate.
    """
    keyed = rates.select(F.col("currency").alias(currency), "day", "rate")
    priced = asof_join(df, keyed, [currency], at, "day", ["rate"])
    factor = F.when(F.col(currency) == base, F.lit(1)).otherwise(F.col("rate"))
    return priced.withColumn(name, F.col(amount) * factor)
