"""Facts per key joined to all rows of the key, with hot keys, NULL keys and clashing names."""

import pytest
from pyspark.sql import functions as F

from rowmill.llm.attach import attach


@pytest.mark.parametrize("frequent", [1, 4, 1000])
@pytest.mark.parametrize("null_is_key", [False, True])
@pytest.mark.parametrize("parts", [None, 5])
def test_attach(llm, frequent, null_is_key, parts):
    keys = ["hot"] * 60 + [None] * 30 + [f"k{i % 17}" for i in range(50)] + ["alone"]
    rows = [(i, k, "x", 1) for i, k in enumerate(keys)]
    df = llm.createDataFrame(rows, "i int, key string, fact_spread string, hot_value int").repartition(3)
    facts = [(k, f"of {k}", keys.count(k)) for k in set(keys) if k != "alone" and (k is not None or null_is_key)]
    known = llm.createDataFrame(facts, "key string, value string, n bigint")
    out = attach(df, "key", known, ["value"], null_is_key=null_is_key, frequent=frequent, parts=parts)
    assert out.columns == ["i", "key", "fact_spread", "hot_value", "value"]
    want = {k: v for k, v, _ in facts}
    assert sorted((r["i"], r["key"], r["value"]) for r in out.collect()) == [(i, k, want.get(k)) for i, k in enumerate(keys)]


def test_hot_rows_are_spread(llm):
    df = llm.range(20_000, numPartitions=8).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"))
    facts = df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("n") * 2)
    out = attach(df, "key", facts, ["v"], frequent=16, parts=8)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 4_000
    assert out.where("key = 'hot' AND v <> 26666 OR v IS NULL").count() == 0


def test_nothing(llm):
    df = llm.createDataFrame([], "key string")
    facts = llm.createDataFrame([], "key string, v int, n bigint")
    assert attach(df, "key", facts, ["v"]).count() == 0
    assert attach(llm.createDataFrame([("a",)], "key string"), "key", facts, ["v"]).collect() == [("a", None)]
