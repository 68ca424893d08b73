"""Facts of a key joined to all rows of the key, however often it occurs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.table import fresh

# A key in more than one of this many rows is frequent; so there are fewer frequent keys than this.
FREQUENT = 4096


def attach(
    df: DataFrame, key: str, facts: DataFrame, values: Sequence[str], count: str = "n", null_is_key: bool = False,
    frequent: int = FREQUENT, parts: int | None = None,
) -> DataFrame:
    """``df`` with the ``values`` of the row of ``facts`` that has its ``key``; NULL where there is none.

    ``facts`` has a row per key, ``count`` telling the rows of ``df`` with it at least roughly. Facts of frequent keys
    (fewer than ``frequent``, by their counts), or all facts when they are no more than that, are sent to
    every task. The others are joined by a shuffle, in which rows of frequent keys are spread by their position, so that no task
    gets a hot key. NULL keys match only with ``null_is_key``, and are spread otherwise. With ``parts`` the rows come
    in that many even partitions. Columns of ``df`` keep their names, ``values`` must not be among them.
    """
    n = len(values)
    own, spread, is_hot, cold_own, cold_spread, *names = fresh(
        df, "hot_key", "fact_spread", "fact_hot", "cold_key", "cold_spread", *(f"hot_{v}" for v in values), *(f"cold_{v}" for v in values)
    )
    size = facts.agg(F.count(F.lit(1)).alias("keys"), F.sum(count).alias("rows")).first()
    few = size["keys"] <= frequent
    often = F.lit(True) if few else F.col(count) * frequent > size["rows"]

    def renamed(kept: Column, key_name: str, more: Column, value_names: Sequence[str]) -> DataFrame:
        return facts.where(kept).select(F.col(key).alias(key_name), more, *(F.col(v).alias(x) for v, x in zip(values, value_names, strict=True)))

    def same(name: str) -> Column:
        return F.col(key).eqNullSafe(F.col(name)) if null_is_key else F.col(key) == F.col(name)

    rows = df.select("*", F.monotonically_increasing_id().alias(spread))
    hot = renamed(often, own, F.lit(True).alias(is_hot), names[:n])
    # The condition names columns that only one side has.
    rows = rows.join(F.broadcast(hot), same(own), "left")
    if few:
        rows = rows.repartition(parts, spread) if parts else rows
        return rows.select(*(f"`{c}`" for c in df.columns), *(F.col(x).alias(v) for v, x in zip(values, names[:n], strict=True)))
    at_large = F.col(is_hot).isNotNull() if null_is_key else F.col(is_hot).isNotNull() | F.col(key).isNull()
    rows = rows.withColumn(spread, F.when(at_large, F.col(spread) + 1).otherwise(0))
    if parts:
        rows = rows.repartition(parts, key, spread)
    cold = renamed(~often, cold_own, F.lit(0).cast("bigint").alias(cold_spread), names[n:])
    joined = rows.join(cold, same(cold_own) & (F.col(spread) == F.col(cold_spread)), "left")
    found = (F.coalesce(h, c).alias(v) for v, h, c in zip(values, names[:n], names[n:], strict=True))
    return joined.select(*(f"`{c}`" for c in df.columns), *found)
