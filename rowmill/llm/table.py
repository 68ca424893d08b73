"""Reading and guarding the tables that the operators work on."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.session import configure, materialize

# Rows that cross to Python at a time: long texts must not pile up in one batch.
BATCH_ROWS = "1000"
# At most this many bits are sent to the tasks as a filter of keys (8 MB), whatever the number of keys.
FILTER_BITS = 1 << 26


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of the folder, restricted to the columns in use."""
    df = ready(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"{stem}_{uuid.uuid4().hex[:8]}"
        taken.add(name.lower())
        names.append(name)
    return names


def replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with the given columns at its end; columns of the same name (in any case) give way."""
    gone = {n.lower() for n in new}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]
    return df.select(*kept, *(c.alias(n) for n, c in new.items()))


def lowered(column: Column | str) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class KeyFilter:
    """A bit per hashed key, of bounded size: false positives occur, false negatives never.

    Sent to tasks ahead of a shuffle, so that rows whose key cannot match stay where they are. With
    more keys than bits it lets everything through: results never depend on it.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - (len(bits) * 8 - 1).bit_length())

    @classmethod
    def of(cls, keys: DataFrame, column: str, expected: int) -> KeyFilter:
        """From a bigint column; bits are gathered by an aggregate with one row per 64-bit word."""
        size = min(FILTER_BITS, max(1 << 13, 1 << (16 * max(expected, 1)).bit_length()))
        slot = f"shiftrightunsigned(`{column}`, {64 - (size - 1).bit_length()})"
        words = (
            keys.where(F.col(column).isNotNull())
            .groupBy(F.expr(f"shiftright({slot}, 6)").alias("word"))
            .agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} & 63 as int)))").alias("bits"))
        )
        found = np.zeros(size // 64, np.int64)
        for r in words.toLocalIterator():
            found[r["word"]] = r["bits"]
        return cls(found.view(np.uint8))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Whether each unsigned 64-bit key may be among the keys."""
        slot = keys >> self.shift
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 != 0


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    return materialize(df, f"llm-{label}")
