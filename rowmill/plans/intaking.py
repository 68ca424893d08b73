"""Registered queries of documents as they arrive, profiles of files, and profiles that add up."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators import sketches
from rowmill.operators.profile import column_facts, union_all
from rowmill.plans.files import workbook_bytes
from rowmill.plans.profiles import profile_file as one_profile
from rowmill.plans.registry import query
from rowmill.session import scratch_dir
from rowmill.sources.tables import read_table
from rowmill.streaming import intake

# Executors need not have this package installed: the workbook writer travels with its tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_DOCUMENTS = """docs AS (SELECT c_custkey // 50 AS chunk,
string_agg(c_custkey || ',' || c_name, chr(10) ORDER BY c_custkey) || chr(10) AS content FROM customer GROUP BY 1)"""


def _arrive(spark: SparkSession, folder: str, out: str, wanted) -> None:
    """Documents of fifty customers each, a text file per document."""
    c = read_table(spark, folder, "customer", ["c_custkey", "c_name"])
    chunk = F.floor(F.col("c_custkey") / 50).alias("chunk")
    rows = c.select(chunk, "c_custkey", F.concat_ws(",", "c_custkey", "c_name").alias("line")).where(wanted(F.col("chunk")))
    # A number that is told is kept: small files cost their number, not their bytes, by which partitions would be merged.
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    in_order = rows.repartition(tasks, "chunk").sortWithinPartitions("chunk", "c_custkey").select("chunk", "line")
    # Tasks put their files in place, not the driver one by one; a repeated task writes the same names.
    in_order.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("chunk").text(out)


@query(f"""WITH {_DOCUMENTS} SELECT sha256(content) AS digest, strlen(content) AS size_bytes, 'txt' AS ext, 'unknown format' AS note,
CASE WHEN chunk % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS arrivals FROM docs""")
def intake_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Two arrivals of documents, some contents in both; the catalogue has each once."""
    inbox, log = scratch_dir(spark, "inbox"), scratch_dir(spark, "inbox-log")
    table = intake.catalogue_table(spark, scratch_dir(spark, "documents"), buckets=16)
    _arrive(spark, folder, f"{inbox}/monday", lambda c: c % 3 != 1)
    intake.take_in(intake.arriving_documents(spark, inbox), table, log)
    _arrive(spark, folder, f"{inbox}/tuesday", lambda c: c % 3 != 2)
    intake.take_in(intake.arriving_documents(spark, inbox), table, log)
    return intake.listed(table).select("digest", "size_bytes", "ext", "note", "arrivals")


_FIRST = """(SELECT string_agg(v, '|' ORDER BY p) FROM (SELECT v, min(p) AS p FROM (SELECT CAST({c} AS VARCHAR) AS v, c_custkey AS p
FROM customer WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 50) GROUP BY v ORDER BY 2 LIMIT 5))"""
_SHOWN = (("c_custkey", "int"), ("c_name", "string"), ("c_mktsegment", "string"))


@query(" UNION ALL ".join(
    f"""SELECT '{f}' AS format, 'utf-8' AS encoding, 0::BIGINT AS notes, '{r}' AS region, count(*) AS row_count, '{c}' AS column_name,
    '{k}' AS inferred_type, count(DISTINCT {c}) AS distinct_count, {_FIRST.format(c=c)} AS samples FROM customer"""
    for f, r in (("csv", "default"), ("json", "default"), ("xlsx", "people")) for c, k in _SHOWN))
def profile_file(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as delimited text, as lines of JSON and as a workbook, each profiled in one call, in file order."""
    c = read_table(spark, folder, "customer", [c for c, _ in _SHOWN])
    csv, json, xlsx = (f"{scratch_dir(spark, 'profile')}.{ext}" for ext in ("csv", "json", "xlsx"))
    # Ranges of keys become files whose names are in the same order.
    in_order = c.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    in_order.write.option("header", True).csv(csv)
    in_order.write.json(json)
    books = c.groupBy(F.floor(F.col("c_custkey") / 500).alias("chunk")).applyInPandas(_people_book, "chunk string, content binary")
    # The bytes of a workbook reach their file by way of the text writer, which ends each with a zero.
    content = books.select("chunk", F.col("content").cast("string"))
    content.write.option("encoding", "ISO-8859-1").option("lineSep", "\x00").partitionBy("chunk").text(f"{xlsx}/books")
    _rename_to(spark, f"{xlsx}/books", xlsx, "xlsx")
    profiles = union_all([one_profile(spark, p) for p in (csv, json, xlsx)])
    regions = profiles.select("format", "encoding", F.size("notes").cast("bigint").alias("notes"), F.explode("regions").alias("r"))
    columns = regions.select("format", "encoding", "notes", "r.name", "r.row_count", F.explode("r.columns").alias("c"))
    return columns.select(
        "format", "encoding", "notes", F.col("name").alias("region"), "row_count", F.col("c.name").alias("column_name"),
        F.col("c.inferred_type").alias("inferred_type"), F.col("c.distinct_count").alias("distinct_count"),
        F.concat_ws("|", "c.samples").alias("samples"),
    )


def _people_book(chunk: pd.DataFrame) -> pd.DataFrame:
    rows = chunk.sort_values("c_custkey")
    content = workbook_bytes({"people": [list(rows.columns), *rows.values.tolist()]})
    return pd.DataFrame({"chunk": [f"{rows['c_custkey'].iloc[0]:012d}"], "content": [content]})


def _rename_to(spark: SparkSession, source: str, target: str, ext: str) -> None:
    """Move the files that Spark wrote by chunk, so that their names end in ``ext`` and keep the order of the chunks."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(str(s.getPath()) for s in files.globStatus(path(f"{source}/chunk=*/part-*")))
    for i, name in enumerate(found):
        files.rename(path(name), path(f"{target}/{i:06d}.{ext}"))
    files.delete(path(source), True)


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS row_count, round_even((count(*) - count({c})) / count(*), 4) AS null_rate,
    count(DISTINCT {c}) AS distinct_count, TRUE AS within FROM orders""" for c in _ORDER_COLUMNS))
def merged_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of three loads added up; distinct counts are estimates, within 3 % of the exact ones beside them."""
    orders = read_table(spark, folder, "orders", _ORDER_COLUMNS)
    store = scratch_dir(spark, "profiles")
    for i in range(3):
        sketches.add_load(spark, store, orders.where(F.col("o_orderkey") % 3 == i), f"part{i}")
    # A load that is sent again counts once.
    sketches.add_load(spark, store, orders.where(F.col("o_orderkey") % 3 == 1), "part1")
    merged = sketches.merged_profile(sketches.stored_loads(spark, store))
    exact = column_facts({"": orders}).select("column", "distinct_values")
    error = F.abs(F.col("distinct_estimate") - F.col("distinct_values"))
    return merged.join(exact, "column").select(
        F.col("column").alias("column_name"), "row_count", "null_rate", F.col("distinct_values").alias("distinct_count"),
        (error <= 0.03 * F.col("distinct_values")).alias("within"),
    )
