"""Exact nearest binary codes by multi-index hashing with growing radii."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.table import ready, saved

# Bits of a segment at most: the masks of a radius are listed, a million of them where seven of 28 bits are set.
WIDEST_SEGMENT = 28


def _widths(bits: int, rows: int) -> list[int]:
    """Segments of such a width that a value has four to eight rows on average.

    Wider ones make for fewer rows to compare, but the values to look up grow faster. The width follows the rows up to
    10 ** 9 of them; beyond that, buckets grow and adaptive execution splits the join's largest.
    """
    ideal = min(WIDEST_SEGMENT, max(4, math.floor(math.log2(max(rows, 4) / 4))))
    m = max(1, math.ceil(bits / ideal))
    return [bits // m + (i < bits % m) for i in range(m)]


def segments(vectors: Column, widths: list[int]) -> Column:
    """Sign bits of a vector (1 where above zero) cut into segments; NULL for NULL or another length."""
    bits = sum(widths)
    ends = np.cumsum(widths)

    @F.arrow_udf("array<int>")
    def apply(column: pa.Array) -> pa.Array:
        lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        good = lengths == bits
        flat = column.filter(pa.array(good)).flatten().fill_null(0).to_numpy(zero_copy_only=False)
        signs = (flat.reshape(-1, bits) > 0).astype(np.int32)
        out = np.zeros((len(column), len(widths)), np.int32)
        for i, (end, width) in enumerate(zip(ends, widths, strict=True)):
            weights = 1 << np.arange(width - 1, -1, -1, dtype=np.int32)
            out[good, i] = signs[:, end - width : end] @ weights
        offsets = pa.array(np.arange(0, len(column) * len(widths) + 1, len(widths)), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(~good))

    return apply(vectors)


def _distance(a: Column, b: Column, m: int) -> Column:
    total = F.lit(0)
    for i in range(m):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total.cast("int")


def nearest(rows: DataFrame, queries: DataFrame, k: int, bits: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, neighbour_id, distance``: the ``k`` rows nearest to each query by Hamming distance.

    Codes are the signs of the vectors. Equal distances are ordered by id, so the answer is exact and unique; a row
    that is a query too is its own neighbour. Step ``s`` looks up every value of segment ``s % m`` that is ``s // m``
    bits from the query's; a code at distance ``d`` has a segment within ``d // m`` bits, and is sure to be met by
    step ``d``. So after step ``s`` all codes up to distance ``s`` are known, and a query is done when its kth
    distance is among them: every round takes the queries that are not done one radius further, the last one
    only as many segments as their kth distance asks for. A code counts at the step that meets it first.

    Rows of equal codes are one entry with its ``k`` smallest ids (no other can be an answer), so copies do
    not multiply. A segment value of many codes is a hot key of a sort-merge join, whose partition adaptive execution
    splits. Ids are of any type that has an order, and come back as they are. NULL ids, NULL vectors and vectors of another length are neither rows nor queries; a query
    with fewer than ``k`` rows to find gets all of them. Repeated rows count each; a repeated query id counts once
    per distinct code.
    """
    spark = ready(rows.sparkSession)
    kind = rows.schema[id_column].dataType.simpleString()
    widths = _widths(bits, rows.count())
    m = len(widths)

    def coded(df: DataFrame) -> DataFrame:
        ids = df.where(F.col(f"`{id_column}`").isNotNull()).select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("v"))
        return ids.select("id", segments(F.col("v"), widths).alias("code")).where("code IS NOT NULL")

    order = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    firsts = coded(rows).withColumn("n", order).where(F.col("n") <= k)
    table = saved(firsts.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    spread = table.select("code", "ids", F.posexplode("code").alias("segment", "value"))
    index = saved(spread, "code-index")
    state = saved(
        coded(queries).distinct().select(
            F.col("id").alias("query_id"), F.col("code").alias("query"),
            F.expr(f"cast(array() as array<struct<distance:int,id:{kind}>>)").alias("best"),
        ),
        "code-queries",
    )
    for radius in range(max(widths) + 1):
        done_steps = radius * m
        # The kth distance found so far, or more than any distance.
        bound = F.when(F.size("best") >= k, F.element_at("best", -1)["distance"]).otherwise(bits)
        open_ = state.withColumn("bound", bound).where(F.col("bound") >= done_steps)
        if radius and open_.isEmpty():
            break
        wide = [_literal(_masks(w, radius)) for w in widths]
        last = F.least(F.col("bound") - done_steps, F.lit(m - 1))
        probes = open_.select(
            "query_id", "query", "bound",
            F.explode(F.slice(F.array(*(F.struct(F.lit(i).alias("segment"), wide[i].alias("masks")) for i in range(m))), F.lit(1), last + 1)).alias("step"),
        ).select(
            "query_id", "query", "bound", F.col("step.segment").alias("segment"),
            F.get("query", F.col("step.segment")).alias("own"), F.explode("step.masks").alias("mask"),
        ).select("query_id", "query", "bound", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        steps = [F.bit_count(F.get("query", F.lit(i)).bitwiseXOR(F.get("code", F.lit(i)))) * m + i for i in range(m)]
        first_met = F.least(*steps) if m > 1 else steps[0]
        met = (
            probes.join(index.hint("merge"), ["segment", "value"])
            .where(first_met == done_steps + F.col("segment"))
            .withColumn("distance", _distance(F.col("query"), F.col("code"), m))
            .where(F.col("distance") <= F.col("bound"))
            .select("query_id", "query", "distance", F.explode("ids").alias("id"))
        )
        old = state.select("query_id", "query", F.explode_outer("best").alias("b")).select("query_id", "query", "b.distance", "b.id")
        rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.col("distance").asc_nulls_last(), "id"))
        top = old.unionByName(met).withColumn("n", rank).where(F.col("n") <= k)
        pairs = F.filter(F.collect_list(F.struct("distance", "id")), lambda x: x["distance"].isNotNull())
        state = saved(top.groupBy("query_id", "query").agg(F.sort_array(pairs).alias("best")), "code-queries")
    return state.select("query_id", F.posexplode("best").alias("n", "b")).select(
        "query_id", (F.col("n") + 1).alias("rank"), F.col("b.id").alias("neighbour_id"), F.col("b.distance").alias("distance")
    )


def _masks(width: int, radius: int) -> list[int]:
    """All values of ``width`` bits of which ``radius`` are set."""
    return [sum(1 << i for i in places) for places in combinations(range(width), radius)]


def _literal(values: list[int]) -> Column:
    """A constant array (as text, so that long ones do not make a long expression)."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<int>")
