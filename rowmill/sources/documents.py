"""Documents: choice of reader, catalogue, collections of files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.errors import UnsupportedFormat
from rowmill.operators.infer import typed
from rowmill.sources.delimited import SOURCE, read_csv, read_delimited, read_tsv
from rowmill.sources.json_files import flattened, read_json
from rowmill.sources.workbook import read_workbooks

Regions = tuple[dict[str, DataFrame], list[str]]


def _csv(spark: SparkSession, path: str, positions: bool = False) -> Regions:
    return {"default": read_csv(spark, path, positions=positions)}, []


def _tsv(spark: SparkSession, path: str, positions: bool = False) -> Regions:
    return {"default": read_tsv(spark, path, positions=positions)}, []


def _json(spark: SparkSession, path: str, positions: bool = False) -> Regions:
    regions, notes = read_json(spark, path, positions)
    return {name: flattened(df) for name, df in regions.items()}, notes


READERS: dict[str, Callable[..., Regions]] = {
    "csv": _csv,
    "tsv": _tsv,
    "json": _json,
    "xlsx": read_workbooks,
}


def extension(name: str) -> str:
    """Lower-case extension, checked against the known readers."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""
    if ext not in READERS:
        raise UnsupportedFormat(f"unsupported extension {ext!r}; known: {', '.join(sorted(READERS))}")
    return ext


def read_document(
    spark: SparkSession, path: str, ext: str | None = None, infer: bool = True, first_rows: int | None = None,
    positions: bool = False,
) -> Regions:
    """Regions of a document as frames, with inferred types unless ``infer`` is off, and notes.

    With ``positions`` every row carries its place in the files (file, block, row, part) in the column ``AT``.
    ``first_rows`` infers from a leading window instead of reading everything for it.
    """
    regions, notes = READERS[extension(f"x.{ext}" if ext else path)](spark, path, positions)
    if infer:
        regions = {name: typed(df, first_rows) for name, df in regions.items()}
    return regions, notes


def read_collection(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """Many delimited files of one shape in a single scan, with ``document`` naming each row's file."""
    rows, _ = read_delimited(spark, paths, sep)
    return rows.withColumnRenamed(SOURCE, "document")


def document_catalogue(spark: SparkSession, path: str, search: str | None = None) -> DataFrame:
    """``document, ext, size_bytes, modified`` of the files below ``path``, newest first.

    File contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(name.contains("."), F.lower(F.element_at(F.split(name, "[.]"), -1))).otherwise("")
    out = files.select(
        name.alias("document"), ext.alias("ext"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")
    )
    if search:
        out = out.filter(F.lower("document").contains(search.lower()))
    return out.orderBy(F.col("modified").desc_nulls_last(), "document")
