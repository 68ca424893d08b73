"""Foreign keys by value: every pair of columns of one kind, whatever their names.

Each column gets a bottom-k sketch, the k smallest digests of its distinct values, up to a bound of its own. Below the
smaller bound of two columns both sketches are complete, so a digest of the child that the parent lacks there is
a value that the parent lacks: the pair is ruled out, and none that holds ever is. What is left is tested exactly,
all pairs in one grouping by value.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rowmill.operators.infer import type_name
from rowmill.operators.profile import column_facts, long_cells, rate
from rowmill.operators.structure import inclusion, names_agree
from rowmill.session import materialize

SKETCH_SIZE = 1024
FOUND = (
    "child_table string, child_column string, parent_table string, parent_column string, child_distinct bigint, "
    "parent_distinct bigint, parent_coverage double, same_name boolean"
)


@dataclass
class Pruning:
    """How many pairs each step left."""

    pairs: int  # of one kind, in different tables, with a unique parent
    by_count: int  # the child has no more values than the parent
    by_sketch: int  # no value of the child's sketch is missing
    confirmed: int = 0


def _sketches(cells: DataFrame, size: int) -> DataFrame:
    """``cid, digest, bound``: the smallest digests of each column's values, and up to where they are all of them.

    Distinct digests are found on the map side first; the rank limit keeps ``size`` per column and task, so a sketch
    costs each task no more than that.
    """
    digests = cells.select("cid", F.xxhash64("as_long", F.coalesce("as_text", F.lit(""))).alias("digest")).distinct()
    place = F.row_number().over(W.partitionBy("cid").orderBy("digest"))
    kept = digests.withColumn("place", place).where(F.col("place") <= size)
    # A sketch that is not full holds all values.
    bound = F.when(F.count(F.lit(1)) < size, F.lit((1 << 63) - 1)).otherwise(F.max("digest")).alias("bound")
    # One row per column of the schema.
    found = kept.join(F.broadcast(kept.groupBy("cid").agg(bound)), "cid").select("cid", "digest", "bound")
    return materialize(found, "sketches")


def _contained(sketches: DataFrame, pairs: list[tuple[int, int]], spark: SparkSession) -> set[tuple[int, int]]:
    """Pairs (child, parent) none of whose compared digests is missing on the parent's side.

    Sketches have a bounded size and there is one per column, so this work grows with the schema, not with the data.
    """
    wanted = spark.createDataFrame(pairs, "child int, parent int")
    bounds = sketches.groupBy("cid").agg(F.first("bound").alias("bound"))
    both = (
        wanted.join(bounds.withColumnsRenamed({"cid": "child", "bound": "child_bound"}), "child")
        .join(bounds.withColumnsRenamed({"cid": "parent", "bound": "parent_bound"}), "parent")
        .select("child", "parent", F.least("child_bound", "parent_bound").alias("bound"))
    )
    # Child digests below the common bound, and whether the parent's sketch has them.
    asked = both.join(sketches.select(F.col("cid").alias("child"), "digest"), "child").where(F.col("digest") <= F.col("bound"))
    held = sketches.select(F.col("cid").alias("parent"), "digest", F.lit(True).alias("held"))
    missing = asked.join(held, ["parent", "digest"], "left").groupBy("child", "parent").agg(
        F.count_if(F.col("held").isNull()).alias("missing")
    )
    ruled_out = {(r["child"], r["parent"]) for r in missing.where("missing > 0").collect()}
    return {p for p in pairs if p not in ruled_out}


def foreign_keys_by_value(tables: Mapping[str, DataFrame], sketch_size: int = SKETCH_SIZE) -> tuple[DataFrame, Pruning]:
    """All foreign keys that the data allows, and how the pairs were pruned.

    A pair holds when the child has values, all of them are values of the parent column, and that column has no value twice
    (gaps are no values). Kinds are whole numbers and texts. ``child_distinct, parent_distinct``,
    ``parent_coverage`` (their ratio: low for accidental inclusions such as small counters in any key), and whether
    the names agree, help to choose; nothing is left out. Tables are scanned three times: for counts, sketches and tests.
    """
    spark = next(iter(tables.values())).sparkSession
    schema = spark.createDataFrame([], FOUND)
    kinds = {
        (t, c): type_name(dtype) for t, df in tables.items() for c, dtype in df.dtypes if dtype == "string" or type_name(dtype) == "int"
    }
    wanted = {t: df.select(*[f"`{c}`" for c in df.columns if (t, c) in kinds]) for t, df in tables.items()}
    wanted = {t: df for t, df in wanted.items() if df.columns}
    if not wanted:
        return schema, Pruning(0, 0, 0)
    # One row per column of the schema.
    facts = {(r["region"], r["column"]): r for r in column_facts(wanted).collect()}
    unique = [c for c, f in facts.items() if f["distinct_values"] > 0 and f["distinct_values"] == f["row_count"] - f["null_count"]]
    pairs = [
        (c, p) for p in unique for c in kinds if c[0] != p[0] and kinds[c] == kinds[p] and facts[c]["distinct_values"] > 0
    ]
    fitting = [(c, p) for c, p in pairs if facts[c]["distinct_values"] <= facts[p]["distinct_values"]]
    if not fitting:
        return schema, Pruning(len(pairs), 0, 0)
    used = {c for pair in fitting for c in pair}
    ids, cells = long_cells(wanted, lambda t, name, _: (t, name) in used)
    number = {c: i for i, c in enumerate(ids)}
    numbered = [(number[c], number[p]) for c, p in fitting]
    kept = _contained(_sketches(cells, sketch_size), numbered, spark)
    left = [(c, p) for c, p in fitting if (number[c], number[p]) in kept]
    stats = Pruning(len(pairs), len(fitting), len(left))
    if not left:
        return schema, stats
    tested = {c for pair in left for c in pair}
    ids, cells = long_cells(wanted, lambda t, name, _: (t, name) in tested)
    number = {c: i for i, c in enumerate(ids)}
    counted = inclusion(cells, [(c, p, number[c], number[p]) for c, p in left])
    held = counted.where("child_distinct > 0 AND matched = child_distinct").collect()
    rows = [
        (
            r["child_table"], r["child_column"], r["parent_table"], r["parent_column"], r["child_distinct"], r["parent_distinct"],
            names_agree(r["child_table"], r["child_column"], r["parent_table"], r["parent_column"]),
        )
        for r in held
    ]
    stats.confirmed = len(rows)
    names = [c.split()[0] for c in FOUND.split(", ") if not c.startswith("parent_coverage")]
    out = spark.createDataFrame(rows, ", ".join(c for c in FOUND.split(", ") if c.split()[0] in names))
    covered = rate(F.col("child_distinct"), F.col("parent_distinct")).alias("parent_coverage")
    return out.select(*names[:6], covered, "same_name"), stats


def best_parents(found: DataFrame) -> DataFrame:
    """The likeliest parent of each child column: of an agreeing name, then the one with the largest share of its keys in use.

    Ties go by the names of table and column.
    """
    order = F.struct(~F.col("same_name"), -F.col("parent_coverage"), "parent_table", "parent_column")
    rest = F.struct("parent_table", "parent_column", "child_distinct", "parent_distinct", "parent_coverage", "same_name")
    best = found.groupBy("child_table", "child_column").agg(F.min_by(rest, order).alias("b"))
    return best.select("child_table", "child_column", "b.*")
