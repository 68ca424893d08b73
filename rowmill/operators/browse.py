"""Browsing stored tables: typed filters, sorts, pages and read-only SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rowmill.errors import BadFilter, BadSort
from rowmill.functions.convert import rendered
from rowmill.operators.infer import type_name

DEFAULT_LIMIT = 100
MAX_LIMIT = 500
READ_ROWS = 50

_COMPARE = {
    "eq": Column.__eq__,
    "neq": Column.__ne__,
    "gt": Column.__gt__,
    "gte": Column.__ge__,
    "lt": Column.__lt__,
    "lte": Column.__le__,
}
OPERATORS = (*_COMPARE, "contains")


def default_operator(dtype: str) -> str:
    """Operator assumed when a filter names none."""
    return "contains" if type_name(dtype) == "string" else "eq"


# The words that stand for a boolean in a filter.
BOOLEAN_WORDS = {"true": True, "t": True, "1": True, "false": False, "f": False, "0": False}

# What reads a filter's text, by the class of the column's type; other classes take the text itself.
_LITERALS: dict[str, Callable[[str], object]] = {
    "int": int, "float": float, "decimal": Decimal, "bool": lambda text: BOOLEAN_WORDS[text.lower()],
}


def coerce(text: str, dtype: str) -> Column:
    """Filter literal in the column's type; dates and times are cast by the engine."""
    kind = "decimal" if dtype.startswith("decimal") else type_name(dtype)
    if kind in ("date", "datetime"):
        return F.lit(text).cast(dtype)
    try:
        return F.lit(_LITERALS.get(kind, str)(text))
    except (ValueError, KeyError, InvalidOperation):
        raise BadFilter(f"cannot read {text!r} as {kind}") from None


def contains(c: Column, text: str, literal: bool = False) -> Column:
    """Case-insensitive substring of the column's text; ``literal`` takes % and _ as plain characters."""
    if literal:
        for ch in ("\\", "%", "_"):
            text = text.replace(ch, "\\" + ch)
    return c.cast("string").ilike(f"%{text}%")


@dataclass(frozen=True)
class Filter:
    """One condition on a column."""

    column: str
    operator: str
    text: str

    @classmethod
    def parse(cls, raw: str) -> Filter:
        """From ``column:operator:value``; the value may hold colons."""
        found = _FILTER.match(raw)
        if not found:
            raise BadFilter(f"{raw!r} is not a column, one of {'/'.join(OPERATORS)} and a value, with colons between")
        return cls(*found.groups())

    def on(self, types: Mapping[str, str], literal: bool) -> Column:
        if self.column not in types:
            raise BadFilter(f"no column {self.column!r}")
        cell = F.col(f"`{self.column}`")
        if self.operator == "contains":
            return contains(cell, self.text, literal)
        return _COMPARE[self.operator](cell, coerce(self.text, types[self.column]))


_FILTER = re.compile(rf"([^:]+):({'|'.join(OPERATORS)}):(.*)", re.DOTALL)


def predicate(df: DataFrame, filters: Sequence[str], literal: bool = False) -> Column | None:
    """Conjunction of ``column:operator:value`` filters; a NULL cell never matches."""
    types = dict(df.dtypes)
    parts = [Filter.parse(raw).on(types, literal) for raw in filters]
    return reduce(Column.__and__, parts) if parts else None


def ordering(df: DataFrame, sort: str | None, direction: str, keys: Sequence[str]) -> list[Column]:
    """Sort columns with NULL last ascending and first descending, key columns as tie-breaker."""
    if sort is not None and sort not in df.columns:
        raise BadSort(f"unknown column {sort!r}")
    way = direction.lower()
    if way not in ("asc", "desc"):
        raise BadSort("direction must be asc or desc")
    lead = sort if sort is not None else (keys[0] if keys else None)
    if lead is None:
        return []
    c = F.col(f"`{lead}`")
    first = c.asc_nulls_last() if way == "asc" else c.desc_nulls_first()
    return [first, *[F.col(f"`{k}`").asc_nulls_last() for k in keys if k != lead]]


def _after(keys: Sequence[str], last: Sequence[object]) -> Column:
    """Rows past ``last`` in lexicographic key order; the leading bound is a plain range that reaches the scan."""
    cases = []
    for i, (k, v) in enumerate(zip(keys, last, strict=True)):
        ties = [F.col(f"`{a}`") == F.lit(b) for a, b in zip(keys[:i], last[:i], strict=True)]
        cases.append(reduce(Column.__and__, [*ties, F.col(f"`{k}`") > F.lit(v)]))
    past = reduce(Column.__or__, cases)
    return past if len(keys) == 1 else (F.col(f"`{keys[0]}`") >= F.lit(last[0])) & past


@dataclass(frozen=True)
class Page:
    """Up to ``limit`` rows; ``probe`` holds one more to tell whether another page follows."""

    probe: DataFrame
    limit: int
    keys: tuple[str, ...] = ()
    offset: int | None = None

    @property
    def rows(self) -> DataFrame:
        return self.probe.limit(self.limit)

    def fetch(self) -> tuple[list[Row], object]:
        """Rows of the page and the cursor of the next one, None on the last."""
        got = self.probe.collect()
        if len(got) <= self.limit:
            return got, None
        got = got[: self.limit]
        if self.offset is not None:
            return got, self.offset + self.limit
        return got, tuple(got[-1][k] for k in self.keys)


def browse(
    df: DataFrame,
    keys: Sequence[str] = (),
    filters: Sequence[str] = (),
    sort: str | None = None,
    direction: str = "asc",
    cursor: object = None,
    limit: int = DEFAULT_LIMIT,
    literal: bool = False,
) -> Page:
    """A page by key when neither sort nor filter is given and a key exists, else by offset.

    Both forms end in a top-k plan, so no page sorts the table.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise BadFilter(f"limit must be between 1 and {MAX_LIMIT}")
    where = predicate(df, filters, literal)
    order = ordering(df, sort, direction, keys)
    if sort is None and not filters and keys:
        rows = df
        if cursor is not None:
            rows = df.filter(_after(keys, cursor if isinstance(cursor, tuple) else (cursor,)))
        rows = rows.orderBy(*[F.col(f"`{k}`").asc() for k in keys])
        return Page(rows.limit(limit + 1), limit, tuple(keys))
    # Figures of other scripts and superscripts are no position, like any other text.
    figures = isinstance(cursor, str) and cursor.isascii() and cursor.isdecimal()
    start = int(cursor) if isinstance(cursor, int) or figures else 0
    rows = df.filter(where) if where is not None else df
    rows = rows.orderBy(*order) if order else rows
    rows = rows.offset(start) if start else rows
    return Page(rows.limit(limit + 1), limit, tuple(keys), start)


def render(df: DataFrame) -> DataFrame:
    """Cells as shown to a reader."""
    return df.select(*[rendered(F.col(f"`{c}`"), t).alias(c) for c, t in df.dtypes])


def read_frame(spark: SparkSession, sql: str) -> DataFrame:
    """Frame of one read-only statement.

    The text is placed where only a query may stand, so a write or a second statement does not parse.
    """
    text = (sql or "").strip().rstrip(";")
    return spark.sql(f"SELECT * FROM (\n{text}\n)")


@dataclass(frozen=True)
class Answer:
    """The first rows of a statement, and how many it has in all (None: not counted, for all are there)."""

    head: DataFrame
    total: int | None


def read_query(spark: SparkSession, sql: str, cap: int = READ_ROWS) -> Answer:
    """Up to ``cap`` rows of a read-only statement; the rest is counted only if there is any.

    A statement that does not parse or run, or would write, raises ``BadFilter``.
    """
    try:
        frame = read_frame(spark, sql)
        longer = bool(frame.offset(cap).take(1))
        return Answer(frame.limit(cap), frame.count() if longer else None)
    except PySparkException as problem:
        raise BadFilter(f"not a readable statement: {problem}") from problem
