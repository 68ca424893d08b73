"""Cleaning and typed conversion of string cells, as built-in column expressions.

Every converter yields NULL for a cell it cannot read; ``operators.clean`` turns such cells into
quarantine rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.options import NULL_TOKENS

WHITESPACE = " \t\r\n"

# Boolean spellings, currency symbols and the codes each symbol may stand for.
TRUE_TOKENS = ("y", "yes", "t", "true", "1")
FALSE_TOKENS = ("n", "no", "f", "false", "0")
SYMBOL_CODES = {"$": ("USD",), "€": ("EUR",), "£": ("GBP",), "¥": ("JPY", "CNY"), "₹": ("INR",)}
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy")


def trimmed(c: Column) -> Column:
    """Cell without surrounding whitespace, line breaks included."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Empty or whitespace-only text becomes NULL; other cells keep their inner text."""
    return F.nullif(trimmed(c), F.lit(""))


def token_to_null(c: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """NULL when the trimmed cell spells one of ``tokens``, in any case."""
    names = [t.upper() for t in tokens]
    if not names:
        return c
    return F.when(F.upper(trimmed(c)).isin(names), F.lit(None)).otherwise(c)


def cleaned(c: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Trim, then turn blanks and null spellings into NULL."""
    return token_to_null(blank_to_null(c), tokens)


def to_boolean(c: Column) -> Column:
    """Yes/no spellings to boolean."""
    word = F.lower(trimmed(c))
    return F.when(word.isin(*TRUE_TOKENS), F.lit(True)).when(word.isin(*FALSE_TOKENS), F.lit(False))


def _shape(fmt: str) -> str:
    """Pattern of the texts a date format can read, so the parser never sees the others."""
    out = fmt
    for field in ("yyyy", "MM", "dd"):
        out = out.replace(field, rf"\d{{{len(field)}}}")
    return f"^{out}$"


def to_date(c: Column, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """First format that fits, in the given order."""
    text = trimmed(c)
    return F.coalesce(*[F.when(text.rlike(_shape(f)), F.try_to_date(text, f)) for f in formats])


# The shapes of whole cells that are read as times and numbers; anything else is a reject.
TIMESTAMP_SHAPE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?$"
)
DATE_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
INTEGER_SHAPE = r"^[+-]?[0-9]+$"
NUMBER_SHAPE = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
BOOLEAN_SHAPE = r"^(?i)(true|false|t|f|yes|no|y|n|1|0)$"
AMOUNT_SHAPE = rf"^[+-]?[{''.join(SYMBOL_CODES)}]? ?[+-]?([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)([.][0-9]{{1,2}})?$"
PERCENT_SHAPE = r"^[+-]?[0-9]+([.][0-9]+)? ?%$"


def to_timestamp(c: Column) -> Column:
    """ISO date and time, with or without an offset, to an instant (session zone UTC).

    A time without a date, or a date that lacks a part, is not an instant.
    """
    text = trimmed(c)
    return F.when(text.rlike(TIMESTAMP_SHAPE), text.try_cast("timestamp"))


def to_amount(c: Column) -> Column:
    """Amount with an optional sign, currency symbol and grouping commas to decimal(18,2).

    Commas stand before groups of three digits, and at most two digits follow the point: ``12,50`` and ``1.234,56``
    are rejects, not other amounts.
    """
    text = trimmed(c)
    drop = "".join(SYMBOL_CODES) + ", "
    one_sign = ~text.rlike("[+-].*[+-]")
    return F.when(text.rlike(AMOUNT_SHAPE) & one_sign, F.translate(text, drop, "").try_cast("decimal(18,2)"))


def amount_symbol(c: Column) -> Column:
    """Leading currency symbol (after a sign), NULL when there is none."""
    first = F.substring(F.ltrim(F.translate(trimmed(c), "+-", "")), 1, 1)
    return F.when(first.isin(*SYMBOL_CODES), first)


def symbol_fits_code(amount: Column, code: Column) -> Column:
    """Whether the symbol in ``amount`` may stand for currency ``code``; NULL without a symbol."""
    symbol = amount_symbol(amount)
    result = F.lit(None).cast("boolean")
    for sign, codes in SYMBOL_CODES.items():
        result = F.when(symbol == sign, F.upper(code).isin(*codes)).otherwise(result)
    return result


def to_percent(c: Column) -> Column:
    """``7.5%`` to 0.075; a number without the sign at its end is not a percentage."""
    text = trimmed(c)
    return F.when(text.rlike(PERCENT_SHAPE), F.translate(text, "% ", "").try_cast("decimal(12,6)") / F.lit(100))


def rescale(c: Column, factor: int = 100) -> Column:
    """Whole number of small units (price to cents)."""
    return F.round(c * F.lit(factor)).cast("long")


def joined(*columns: Column, sep: str = " ") -> Column:
    """Derived text from parts; missing parts are skipped."""
    return F.concat_ws(sep, *columns)


def part_of(c: Column, index: int, sep: str = ",") -> Column:
    """Trimmed part ``index`` (0-based) of a composite cell, NULL past the end."""
    return F.nullif(trimmed(F.get(F.split(c, sep), F.lit(index))), F.lit(""))


def rendered(c: Column, dtype: str) -> Column:
    """Cell as shown to a reader: text, whole, floating and boolean kept, the rest as text."""
    if dtype in ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean"):
        return c
    if dtype.startswith(("array", "map", "struct")):
        return F.to_json(c)
    return c.cast("string")
