"""Free-form import instructions, reduced to the switches that change results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# The spellings of "no value" that the cleaning rules name.
NULL_TOKENS = ("N/A", "NULL")


@dataclass(frozen=True)
class ImportOptions:
    """How a load treats null spellings, keys, names, existing tables and currencies."""

    null_tokens: tuple[str, ...] = NULL_TOKENS
    skip_null_keys: bool = False
    snake_case: bool = True
    append: bool = False
    rates: DataFrame | None = None
    # Types from the shapes of all cells: the share of a column's cells that must fit, and the order of dates
    # whose cells leave it open (mdy or dmy).
    typed: bool = False
    min_fit: float = 0.95
    date_order: str = "mdy"
    # Thresholds for the rules stated in prose (repetition, enumerations, tiny documents).
    min_repetition: float = 2.0
    enum_max_values: int = 20
    enum_max_length: int = 32
    flat_below_rows: int = 30
