"""Row-level cleaning: whole-frame blanks, casts with rejects, required values, duplicates, gaps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions import convert
from rowmill.functions.convert import cleaned
from rowmill.operators.ranking import first_per_group
from rowmill.options import ImportOptions

Converter = Callable[[Column], Column]


def clean_text(df: DataFrame, options: ImportOptions | None = None) -> DataFrame:
    """Trim every text column and turn blanks and null spellings into NULL, in one projection."""
    tokens = (options or ImportOptions()).null_tokens
    return df.select(
        *[cleaned(F.col(f"`{c}`"), tokens).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def _convert(target: str | Converter) -> Converter:
    if callable(target):
        return target
    # The text has to have the whole shape of its type: casts alone read '12d', 'NaN' or a date with a tail.
    kind = target.lower()
    shape = (
        convert.INTEGER_SHAPE if kind in ("tinyint", "smallint", "int", "bigint")
        else convert.NUMBER_SHAPE if kind in ("float", "double") or kind.startswith("decimal")
        else convert.DATE_SHAPE if kind == "date"
        else convert.TIMESTAMP_SHAPE if kind.startswith("timestamp")
        else convert.BOOLEAN_SHAPE if kind == "boolean"
        else None
    )
    if shape is None:
        return lambda c: F.trim(c).try_cast(target)
    return lambda c: F.when(convert.trimmed(c).rlike(shape), convert.trimmed(c).try_cast(target))


def try_convert(df: DataFrame, targets: Mapping[str, str | Converter]) -> DataFrame:
    """Convert columns; cells that do not fit become NULL."""
    return df.select(
        *[
            _convert(targets[c])(F.col(f"`{c}`")).alias(c) if c in targets else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def cast_rejects(
    df: DataFrame, keys: Sequence[str], targets: Mapping[str, str | Converter], labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Quarantine rows ``keys, column, value, target`` for cells lost by :func:`try_convert`."""
    found = []
    for name, target in targets.items():
        c = F.col(f"`{name}`")
        label = (labels or {}).get(name) or (target if isinstance(target, str) else target.__name__)
        lost = c.isNotNull() & _convert(target)(c).isNull()
        cell = F.struct(F.lit(name).alias("column"), c.alias("value"), F.lit(label).alias("target"))
        found.append(F.when(lost, cell))
    cells = F.filter(F.array(*found), lambda x: x.isNotNull())
    return df.select(*[f"`{k}`" for k in keys], F.inline(cells))


def _any_null(columns: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.col(f"`{c}`").isNull() for c in columns])


def with_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows that have every required value."""
    return df.filter(~_any_null(required))


def missing_required(df: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Quarantine rows ``keys, column`` for each missing required value."""
    gaps = F.filter(
        F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull()
    )
    return df.select(*[f"`{k}`" for k in keys], F.explode(gaps).alias("column"))


def skip_null_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a complete key, and one row ``kept, dropped``."""
    gap = _any_null(keys)
    counts = df.agg(F.count_if(~gap).alias("kept"), F.count_if(gap).alias("dropped"))
    return df.filter(~gap), counts


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One copy of each whole row."""
    return df.distinct()


def dedupe_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return first_per_group(df, keys, order)


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constants in place of NULL, keeping each column's type."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: F.coalesce(F.col(f"`{c}`"), F.lit(v).cast(types[c])) for c, v in values.items()}
    )


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns under their agreed names."""
    return df.withColumnsRenamed(dict(names))
