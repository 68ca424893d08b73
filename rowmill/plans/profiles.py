"""A document profiled in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators.profile import document_profile, region_profile, union_all
from rowmill.sources.delimited import AT, check_encoding, inspect_text
from rowmill.sources.documents import extension, read_document

NO_REGIONS = (
    "region string, pos int, column string, inferred_type string, row_count long, null_rate double, distinct_count long, samples array<string>"
)


def document_regions(spark: SparkSession, path: str, ext: str | None = None) -> tuple[DataFrame, list[str]]:
    """Profile rows of every region of a document, with samples in file order, and the reader's notes."""
    regions, notes = read_document(spark, path, ext, positions=True)
    found = [
        region_profile(df, [AT], name, [c for c in df.columns if c != AT]) for name, df in regions.items() if df.columns != [AT]
    ]
    return (union_all(found) if found else spark.createDataFrame([], NO_REGIONS)), notes


def profile_file(spark: SparkSession, path: str, ext: str | None = None) -> DataFrame:
    """One nested record for a file or folder: path, size, format, encoding, regions with their columns, and notes.

    Size, encoding and notes come from the read itself: bytes of all files, UTF-8 tested on the raw text (a
    ``BadEncoding`` names a file that is not), and what the reader could not use. A column's samples are the first five
    distinct among its first fifty values in the order of files, blocks and rows. A document without regions has an
    empty list of them.
    """
    kind = extension(f"x.{ext}" if ext else path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    if kind == "json":
        # Delimited text is tested by its reader.
        check_encoding(inspect_text(spark, path))
    regions, notes = document_regions(spark, path, ext)
    return document_profile(regions, path, size, kind, notes=notes)
