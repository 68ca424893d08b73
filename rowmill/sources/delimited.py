"""Comma and tab separated text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.errors import BadEncoding

CORRUPT = "_corrupt_record"
SOURCE = "_source_file"
# Where a row stands: file, block of the file and place in the block, in this order of comparison.
AT = "_at"


def place(*more: Column) -> Column:
    """The position of a scanned row, stable however its blocks are dealt to tasks; ``more`` tells rows of one record apart."""
    at = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    parts = more or (F.lit(0),)
    return F.struct(*at, F.monotonically_increasing_id().alias("row"), *(c.cast("bigint").alias("part") for c in parts))


def inspect_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, lines, bad_lines, open_quotes, header`` per file.

    ``bad_lines`` are not UTF-8 (tested on the raw text, because the delimited reader has replaced
    such bytes already). An odd number of quotes means that a cell continues on the next line.
    """
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = lines.select("value", quotes.alias("quotes"), F.col("_metadata.file_path").alias("file"), at.alias("at"))
    return lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~F.is_valid_utf8("value")).alias("bad_lines"),
        F.count_if(F.col("quotes") % 2 == 1).alias("open_quotes"),
        F.min_by("value", "at").alias("header"),
    )


def check_encoding(report: DataFrame) -> None:
    """Raise when any inspected file is not UTF-8."""
    bad = report.filter("bad_lines > 0").select("file").limit(1).collect()
    if bad:
        name = bad[0]["file"].rsplit("/", 1)[-1]
        raise BadEncoding(f"{name!r} is not UTF-8; export it again as 'CSV UTF-8'")


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    sep: str = ",",
    multiline: bool | None = None,
    check: bool = True,
    positions: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Text columns of one or many files, and the ragged rows. Both frames carry the source file.

    With ``positions`` whole rows carry their place in the files, in the column ``AT``.

    Each file is read by its own header: files with the same columns in another order are matched by name. Rows
    of files that have other columns than the first file (by path) cannot be matched, and come back as ragged. So do
    rows with too few or too many cells. ``multiline=None`` looks for files that have cells with line breaks;
    only these are read by one task each, all others stay splittable. One pass tells both, and the encoding.
    """
    found = list(paths) if not isinstance(paths, str) else paths
    report = inspect_text(spark, found)
    # A row per file, as in the listing that every scan makes.
    files = report.select("file", "header", "bad_lines", (F.col("open_quotes") > 0).alias("open")).orderBy("file").collect()
    if check and any(f["bad_lines"] for f in files):
        check_encoding(report)
    groups: dict[tuple[str, bool], list[str]] = {}
    for f in files:
        broken = f["open"] if multiline is None else multiline
        groups.setdefault((f["header"].rstrip("\r"), broken), []).append(_local(f["file"]))
    if not groups:
        whole, ragged = _read_alike(spark, found, sep, bool(multiline), positions)
        return whole, ragged
    read = [_read_alike(spark, members, sep, broken, positions) for (_, broken), members in groups.items()]
    first = read[0][0]
    wholes, raggeds = [], []
    for whole, ragged in read:
        raggeds.append(ragged)
        if set(whole.columns) == set(first.columns):
            wholes.append(whole.select(*[f"`{c}`" for c in first.columns]))
        else:
            cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in whole.columns if c not in (SOURCE, AT)]
            raggeds.append(whole.select(SOURCE, F.concat_ws(sep, *cells).alias("record")))
    return reduce(DataFrame.unionByName, wholes), reduce(DataFrame.unionByName, raggeds)


def _local(uri: str) -> str:
    """A file's address as the readers take it (they do not decode it)."""
    return unquote(uri) if urlsplit(uri).scheme else uri


def _read_alike(
    spark: SparkSession, found: str | list[str], sep: str, multiline: bool, positions: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Whole and ragged rows of files with one header."""
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        # A pruned read would not notice that a row is short.
        .option("columnPruning", False)
    )
    names = reader.csv(found).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = reader.schema(f"{schema}, {CORRUPT} string").csv(found)
    # The scan refuses to serve the corrupt column alone (a plain count would), so an empty slice of
    # the first cell travels with it.
    mark = F.concat_ws("", F.col(CORRUPT), F.substring(F.col(f"`{names[0]}`"), 1, 0))
    rows = rows.withColumns({SOURCE: F.col("_metadata.file_path"), CORRUPT: mark} | ({AT: place()} if positions else {}))
    whole = rows.filter(F.col(CORRUPT) == "").drop(CORRUPT)
    ragged = rows.filter(F.col(CORRUPT) != "").select(SOURCE, F.col(CORRUPT).alias("record"))
    return whole, ragged


def read_csv(spark: SparkSession, paths: str | Sequence[str], **options: object) -> DataFrame:
    """Whole rows of comma separated files."""
    return read_delimited(spark, paths, ",", **options)[0].drop(SOURCE)


def read_tsv(spark: SparkSession, paths: str | Sequence[str], **options: object) -> DataFrame:
    """Whole rows of tab separated files."""
    return read_delimited(spark, paths, "\t", **options)[0].drop(SOURCE)
