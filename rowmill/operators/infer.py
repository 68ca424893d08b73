"""Types: names for stored columns, inference for text columns, load types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Profile type names by Spark type, and the load type of each.
_NAMES = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int",
    "float": "float", "double": "float",
    "boolean": "bool",
    "date": "date",
    "timestamp": "datetime", "timestamp_ntz": "datetime", "time": "datetime",
    "void": "null",
}
SQL_TYPES = {
    "tinyint": "smallint", "smallint": "smallint", "int": "integer", "bigint": "bigint",
    "float": "real", "double": "double precision", "boolean": "boolean", "date": "date",
    "timestamp": "timestamptz", "timestamp_ntz": "timestamptz",
}
SPARK_TYPES = {
    "text": "string", "integer": "int", "bigint": "bigint", "double precision": "double",
    "boolean": "boolean", "date": "date", "timestamptz": "timestamp", "numeric": "decimal(38,10)",
}

# What a cell must look like before a cast is tried.
PATTERNS = {
    "int": r"^[+-]?[0-9]{1,18}$",
    "float": r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$",
    "bool": r"^(true|false)$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "datetime": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?"
                r"(Z|[+-][0-9]{2}:?[0-9]{2})?$",
}
_CASTS = {"int": "bigint", "float": "double", "bool": "boolean", "date": "date", "datetime": "timestamp"}


def type_name(dtype: str) -> str:
    """One of int, float, bool, date, datetime, null, string."""
    return _NAMES.get(dtype, "string")


def sql_type(dtype: str) -> str:
    """Load type of a stored Spark column."""
    if dtype.startswith("decimal"):
        return "numeric"
    return SQL_TYPES.get(dtype, "text")


def is_nested(dtype: str) -> bool:
    return dtype.startswith(("array", "map", "struct"))


def flat_text(c: Column, dtype: str) -> Column:
    """Column as comparable text: nested values as JSON."""
    return F.to_json(c) if is_nested(dtype) else c.cast("string")


def fits(c: Column, kind: str) -> Column:
    """Whether a text cell reads as ``kind``."""
    text = F.lower(c) if kind == "bool" else c
    return text.rlike(PATTERNS[kind]) & text.try_cast(_CASTS[kind]).isNotNull()


# Codes of :func:`cell_kind`, numbers because they are compared per cell.
KINDS = {"string": 0, "bool": 1, "int": 2, "float": 3, "date": 4, "datetime": 5}


def cell_kind(c: Column) -> Column:
    """Code of the narrowest kind of one text cell, NULL for an empty one.

    Cells that start like a word skip the number and date tests.
    """
    kind = F.when(F.lower(c).isin("true", "false"), KINDS["bool"])
    kind = kind.when(~F.substring(c, 1, 1).isin(*"+-.0123456789"), KINDS["string"])
    # Whole numbers past 18 digits would lose digits as floats.
    kind = kind.when(c.rlike("^[+-]?[0-9]{19,}$"), KINDS["string"])
    for name in ("int", "float", "date", "datetime"):
        kind = kind.when(fits(c, name), KINDS[name])
    return F.when(c.isNotNull(), kind.otherwise(KINDS["string"]))


def infer_types(df: DataFrame, columns: Iterable[str] | None = None, first_rows: int | None = None) -> DataFrame:
    """Narrowest type every non-null cell of each text column fits, in one pass.

    Rows: ``pos, column, row_count, non_null, int_count, float_count, bool_count, date_count,
    datetime_count, max_length, inferred_type, load_type``. ``first_rows`` restricts the look to a
    leading window, as the sampled readers do; by default every cell counts, so a late odd value
    cannot make the load fail.

    The columns are stacked, so the tests are compiled once however wide the table is, and a task
    sends one row per column.
    """
    names = list(columns or df.columns)
    source = df.select(*[f"`{n}`" for n in names])
    if first_rows is not None:
        source = source.limit(first_rows)
    stacked = [x for i, n in enumerate(names) for x in (F.lit(i), F.col(f"`{n}`").cast("string"))]
    cells = source.select(F.stack(F.lit(len(names)), *stacked).alias("pos", "value"))
    cells = cells.withColumn("kind", cell_kind(F.col("value")))
    whole = F.when(F.col("kind") == KINDS["int"], F.col("value").try_cast("bigint"))

    def counted(*kinds: str) -> Column:
        return F.count_if(F.col("kind").isin(*[KINDS[k] for k in kinds]))

    found = cells.groupBy("pos").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("value").alias("non_null"),
        counted("int").alias("int_count"),
        counted("int", "float").alias("float_count"),
        counted("bool").alias("bool_count"),
        counted("date").alias("date_count"),
        counted("datetime").alias("datetime_count"),
        F.min(whole).alias("min_int"),
        F.max(whole).alias("max_int"),
        F.coalesce(F.max(F.length("value")), F.lit(0)).alias("max_length"),
    )
    # A column of an empty table has no cells but is still a column.
    every = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("column")) for i, n in enumerate(names)])
    layout = df.sparkSession.range(1).select(F.inline(every))
    counts = [c for c in found.columns if c not in ("pos", "min_int", "max_int")]
    out = layout.join(found, "pos", "left").select(
        "pos", "column", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "min_int", "max_int"
    )
    full = F.col("non_null")
    inferred = F.when(full == 0, "null")
    # A whole number is also a float, and a date column may carry times, so the wider type counts both.
    inferred = (
        inferred.when(F.col("bool_count") == full, "bool")
        .when(F.col("int_count") == full, "int")
        .when(F.col("float_count") == full, "float")
        .when(F.col("date_count") == full, "date")
        .when(F.col("date_count") + F.col("datetime_count") == full, "datetime")
        .otherwise("string")
    )
    out = out.withColumn("inferred_type", inferred)
    small = F.col("min_int").between(-(2**31), 2**31 - 1) & F.col("max_int").between(-(2**31), 2**31 - 1)
    load = (
        F.when(F.col("inferred_type") == "int", F.when(small, "integer").otherwise("bigint"))
        .when(F.col("inferred_type") == "float", "double precision")
        .when(F.col("inferred_type") == "bool", "boolean")
        .when(F.col("inferred_type") == "date", "date")
        .when(F.col("inferred_type") == "datetime", "timestamptz")
        .otherwise("text")
    )
    return out.withColumn("load_type", load).drop("min_int", "max_int")


def apply_types(df: DataFrame, load_types: dict[str, str]) -> DataFrame:
    """Strict conversion to the load types: a cell that does not fit aborts the job."""
    return df.select(
        *[
            F.col(f"`{c}`").cast(SPARK_TYPES[load_types[c]]).alias(c) if c in load_types else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def typed(df: DataFrame, first_rows: int | None = None) -> DataFrame:
    """Infer the types of the text columns and convert them."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    found = infer_types(df, texts, first_rows).select("column", "load_type").collect()
    return apply_types(df, {r["column"]: r["load_type"] for r in found})


def selected_load_types(df: DataFrame) -> DataFrame:
    """Load type per stored column from its value range: integers that fit 32 bits narrow."""
    ints = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")]
    aggs = [F.min(f"`{c}`").cast("long").alias(f"lo{i}") for i, c in enumerate(ints)]
    aggs += [F.max(f"`{c}`").cast("long").alias(f"hi{i}") for i, c in enumerate(ints)]
    rows = []
    for pos, (name, dtype) in enumerate(df.dtypes):
        kind = F.lit(sql_type(dtype))
        if name in ints:
            i = ints.index(name)
            wide = (F.col(f"lo{i}") < -(2**31)) | (F.col(f"hi{i}") > 2**31 - 1)
            kind = F.when(wide, "bigint").otherwise("integer")
        rows.append(F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("column"), kind.alias("load_type")))
    base = df.agg(*aggs) if aggs else df.agg(F.count(F.lit(1)).alias("n"))
    return base.select(F.inline(F.array(*rows)))
