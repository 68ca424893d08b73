"""Column profiles: types, null rates, exact distinct counts, samples, distributions, duplicates.

A profile reads its table once: the cells of all columns are stacked and grouped by (column, value),
which gives exact distinct counts and filled cells alike (row counts come from file footers). The
grouping aggregates on the map side, so a value that fills a third of a column travels as one row per
task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rowmill.operators.infer import flat_text, is_nested, type_name
from rowmill.session import ident, quoted

SAMPLE_WINDOW = 50
SAMPLE_LIMIT = 5


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def rate(part: Column, total: Column) -> Column:
    """Share rounded to four places, 0.0 for an empty total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(part / F.nullif(total, F.lit(0)), 4))


def column_stats(df: DataFrame) -> DataFrame:
    """``pos, column, inferred_type, row_count, null_count`` in one aggregate."""
    counts = [F.expr(f"count({ident(c)}) AS c{i}") for i, c in enumerate(df.columns)]
    rows = ", ".join(
        f"struct({i} AS pos, {quoted(name)} AS column, {quoted(type_name(dtype))} AS inferred_type, "
        f"n AS row_count, n - c{i} AS null_count)"
        for i, (name, dtype) in enumerate(df.dtypes)
    )
    found = df.agg(F.count(F.lit(1)).alias("n"), *counts)
    return found.selectExpr(f"inline(array({rows}))")


# Texts longer than this are compared by digest (65 characters).
LONG_TEXT = 64

# Columns that carry a cell's value in the long form: exactly one of them is filled.
VALUES = ("as_long", "as_double", "as_text")


def _typed_cells(name: str, dtype: str) -> str:
    """The cell under the value column of its class, as SQL; numbers and times stay numbers to keep keys short."""
    c = ident(name)
    empty = ["CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)"]
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        empty[0] = f"CAST({c} AS BIGINT)"
    elif dtype == "boolean":
        empty[0] = f"CAST(CAST({c} AS INT) AS BIGINT)"
    elif dtype == "date":
        empty[0] = f"CAST(unix_date({c}) AS BIGINT)"
    elif dtype in ("timestamp", "timestamp_ntz"):
        empty[0] = f"unix_micros(CAST({c} AS TIMESTAMP))"
    elif dtype in ("float", "double"):
        empty[1] = f"CAST({c} AS DOUBLE)"
    else:
        text = f"to_json({c})" if is_nested(dtype) else f"CAST({c} AS STRING)"
        # Whole documents would travel through the shuffle only to be compared. A digest is longer than
        # any text left as it is, so the two cannot meet.
        empty[2] = f"CASE WHEN length({text}) > {LONG_TEXT} THEN concat('#', sha2({text}, 256)) ELSE {text} END"
    return ", ".join(empty)


def long_cells(
    tables: Mapping[str, DataFrame],
    wanted: Callable[[str, str, str], bool] | None = None,
    counted: bool = False,
) -> tuple[list[tuple[str, str]], DataFrame]:
    """Non-null cells of many tables as ``cid`` and the value columns.

    ``cid`` numbers the returned (table, column) list, so grouping keys stay short and all columns of
    all tables share one scan per table and one shuffle. ``counted`` adds a constant cell per row of
    table number t under ``cid = -1 - t``; it collapses to a row per task and counts the rows.
    """
    ids: list[tuple[str, str]] = []
    frames = []
    for t, (table, df) in enumerate(tables.items()):
        stacked: list[str] = [f"{-1 - t}, 0L, CAST(NULL AS DOUBLE), CAST(NULL AS STRING)"] if counted else []
        for name, dtype in df.dtypes:
            if wanted is None or wanted(table, name, dtype):
                stacked.append(f"{len(ids)}, {_typed_cells(name, dtype)}")
                ids.append((table, name))
        if stacked:
            long = df.selectExpr(f"stack({len(stacked)}, {', '.join(stacked)}) AS (cid, {', '.join(VALUES)})")
            frames.append(long.filter(_filled()))
    return ids, union_all(frames)


def _filled() -> str:
    return " OR ".join(f"{v} IS NOT NULL" for v in VALUES)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column``, the value columns and ``n`` over the non-null cells."""
    keep = set(columns if columns is not None else df.columns)
    ids, cells = long_cells({"": df}, lambda _, name, __: name in keep)
    names = F.array(*[F.lit(name) for _, name in ids])
    counted = cells.groupBy("cid", *VALUES).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.get(names, F.col("cid")).alias("column"), *VALUES, "n")


def _facts_by_id(cells: DataFrame, columns_of: Sequence[Sequence[int]]) -> DataFrame:
    """``cid, row_count, distinct_values, filled``: values with their counts first, then one row per column.

    ``columns_of`` lists the column numbers of each table, to which its row count is handed on.
    """
    values = cells.groupBy("cid", *VALUES).agg(F.count(F.lit(1)).alias("n"))
    each = values.groupBy("cid").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("filled"))
    lists = "array(" + ", ".join(f"array({', '.join(map(str, c))})" for c in columns_of) + ")"
    rows = F.col("cid") < 0
    targets = F.expr(f"CASE WHEN cid < 0 THEN {lists}[-1 - cid] ELSE array(cid) END")
    spread = each.select(
        F.explode(targets).alias("cid"),
        F.when(rows, F.col("filled")).alias("row_count"),
        F.when(~rows, F.col("distinct_values")).alias("distinct_values"),
        F.when(~rows, F.col("filled")).alias("filled"),
    )
    return spread.groupBy("cid").agg(*(F.max(c).alias(c) for c in ("row_count", "distinct_values", "filled")))


def column_facts(tables: Mapping[str, DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """``region, pos, column, inferred_type, row_count, null_count, distinct_values`` of each column.

    ``distinct_values`` leaves NULL out. Each table is scanned once.
    """
    keep = None if columns is None else set(columns)
    wanted = None if keep is None else lambda _, name, __: name in keep
    ids, cells = long_cells(tables, wanted, counted=True)
    types = {region: dict(df.dtypes) for region, df in tables.items()}
    layout = ", ".join(
        f"struct({cid} AS cid, {quoted(region)} AS region, {list(types[region]).index(name)} AS pos, "
        f"{quoted(name)} AS column, {quoted(type_name(types[region][name]))} AS inferred_type)"
        for cid, (region, name) in enumerate(ids)
    )
    columns_of = [[cid for cid, (region, _) in enumerate(ids) if region == table] for table in tables]
    # One row per column of the schema on either side.
    out = next(iter(tables.values())).sparkSession.range(1).selectExpr(f"inline(array({layout}))")
    out = out.join(F.broadcast(_facts_by_id(cells, columns_of)), "cid", "left")
    count = F.coalesce("row_count", F.lit(0))
    return out.select(
        "region",
        "pos",
        "column",
        "inferred_type",
        count.alias("row_count"),
        (count - F.coalesce("filled", F.lit(0))).alias("null_count"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, distinct_values`` (NULL not counted) with exact counts."""
    return column_facts({"": df}, columns).select("column", "distinct_values")


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``region, pos, column, inferred_type, row_count, null_rate, distinct_count`` per column.

    NULL counts as one distinct value.
    """
    return column_facts(tables).select(
        "region",
        "pos",
        "column",
        "inferred_type",
        "row_count",
        rate(F.col("null_count"), F.col("row_count")).alias("null_rate"),
        (F.col("distinct_values") + F.when(F.col("null_count") > 0, 1).otherwise(0)).cast("long").alias("distinct_count"),
    )


def profile_columns(df: DataFrame) -> DataFrame:
    """:func:`profile_tables` for one frame, without the region."""
    return profile_tables({"": df}).drop("region")


def samples(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``column, rank, value``: first five distinct among the first fifty non-null cells in row order.

    Each task keeps its first fifty rows and sorts no others. Columns with gaps among the first fifty rows are looked at
    once more, each alone.
    """
    types = dict(df.dtypes)
    names = list(columns or df.columns)
    keys = [F.col(f"`{o}`").alias(f"_o{i}") for i, o in enumerate(order)]
    key_names = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*keys, *(flat_text(F.col(f"`{n}`"), types[n]).alias(f"_c{i}") for i, n in enumerate(names)))
    head = rows.orderBy(*key_names).limit(SAMPLE_WINDOW)
    # A row of counts.
    seen = head.agg(F.count(F.lit(1)).alias("n"), *(F.count(f"_c{i}").alias(f"_c{i}") for i in range(len(names)))).first()
    gaps = [i for i in range(len(names)) if seen["n"] == SAMPLE_WINDOW > seen[f"_c{i}"]]
    cells = [F.struct(F.lit(n).alias("column"), F.col(f"_c{i}").alias("value")) for i, n in enumerate(names) if i not in gaps]
    found = [head.select(*key_names, F.inline(F.array(*cells)))] if cells else []
    for i in gaps:
        filled = rows.where(F.col(f"_c{i}").isNotNull()).orderBy(*key_names).limit(SAMPLE_WINDOW)
        found.append(filled.select(*key_names, F.lit(names[i]).alias("column"), F.col(f"_c{i}").alias("value")))
    place = F.row_number().over(W.partitionBy("column").orderBy(*key_names))
    heads = union_all(found).filter("value IS NOT NULL").withColumn("_place", place)
    first = heads.groupBy("column", "value").agg(F.min("_place").alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy("at")))
    return ranked.filter(F.col("rank") <= SAMPLE_LIMIT).select("column", "rank", "value")


def region_profile(
    df: DataFrame, order: Sequence[str], region: str = "default", columns: Sequence[str] | None = None
) -> DataFrame:
    """Profile rows with their samples as an array (at most five each), of all columns or of some."""
    taken = samples(df, order, columns)
    lists = taken.groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("samples")
    )
    shown = df if columns is None else df.select(*[f"`{c}`" for c in columns])
    joined = profile_columns(shown).join(lists, "column", "left")
    empty = F.array().cast("array<string>")
    return joined.withColumn("samples", F.coalesce("samples", empty)).select(F.lit(region).alias("region"), "*")


def document_profile(
    regions: DataFrame,
    path: str,
    size_bytes: int,
    fmt: str,
    encoding: str = "utf-8",
    notes: Sequence[str] = (),
) -> DataFrame:
    """One nested record per document from its region profiles (schema-sized lists only)."""
    columns = F.sort_array(
        F.collect_list(F.struct("pos", "column", "inferred_type", "null_rate", "distinct_count", "samples"))
    )
    per_region = regions.groupBy("region").agg(F.max("row_count").alias("row_count"), columns.alias("c"))
    shaped = per_region.select(
        F.struct(
            F.col("region").alias("name"),
            "row_count",
            F.transform(
                "c",
                lambda s: F.struct(
                    s["column"].alias("name"),
                    s["inferred_type"].alias("inferred_type"),
                    s["null_rate"].alias("null_rate"),
                    s["distinct_count"].alias("distinct_count"),
                    s["samples"].alias("samples"),
                ),
            ).alias("columns"),
        ).alias("r")
    )
    note_list = F.array(*[F.lit(n) for n in notes]) if notes else F.array().cast("array<string>")
    return shaped.agg(F.sort_array(F.collect_list("r")).alias("regions")).select(
        F.lit(path).alias("path"),
        F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("filename"),
        F.lit(size_bytes).cast("long").alias("size_bytes"),
        F.lit(fmt).alias("format"),
        F.lit(encoding).alias("encoding"),
        "regions",
        note_list.alias("notes"),
    )


def profile_json(profile: DataFrame) -> DataFrame:
    """The nested profile as one JSON text per document."""
    return profile.select(F.to_json(F.struct(*profile.columns)).alias("profile"))


# Fixed value: what is said of a document without regions.
NO_REGIONS = "No regions detected."


def profile_summary(
    profiles: DataFrame, document: str = "document", documents: DataFrame | None = None, place: str | None = None
) -> DataFrame:
    """Readable size of each document: one line for one region, a list for several, a sentence for none.

    ``documents`` names all documents, since one without regions has no profile rows. Regions are listed by the column
    ``place`` (their position in the document), or by name.
    """
    regions = profiles.groupBy(document, "region").agg(
        F.max("row_count").alias("rows"),
        F.count(F.lit(1)).alias("cols"),
        (F.min(place) if place else F.lit(0)).alias("place"),
    )
    size = F.concat(F.col("rows").cast("string"), F.lit(" rows · "), F.col("cols").cast("string"), F.lit(" columns"))
    line = F.concat(F.lit("  - `"), F.col("region"), F.lit("`: "), size)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", "region", line.alias("line")))), lambda r: r["line"])
    found = regions.groupBy(document).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("single"), F.concat_ws("\n", lines).alias("lines"))
    if documents is not None:
        found = documents.select(document).distinct().join(found, document, "left")
    return found.select(
        document,
        F.when(F.col("n").isNull(), NO_REGIONS)
        .when(F.col("n") == 1, F.col("single"))
        .otherwise(F.concat(F.col("n").cast("string"), F.lit(" regions\n"), F.col("lines")))
        .alias("summary"),
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """``value, n, share`` of each value, NULL included."""
    total = df.select(F.count(F.lit(1)).alias("total")).scalar()
    counts = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / total)


def find_duplicates(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Key values (or whole rows) that occur more than once, with their count; NULLs group together."""
    keys = list(keys or df.columns)
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
