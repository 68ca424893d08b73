"""Workbooks (.xlsx): every sheet of many files as rows of cells.

One file is one task: the format holds at most 1 048 576 rows per sheet, and a zip archive cannot be
split. Rows leave the parser in small batches.
"""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.session import materialize
from rowmill.sources.delimited import AT

# Executors need not have this package installed: the parser travels with its tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = "file string, sheet string, sheet_no int, row_no long, cells array<string>"
_BATCH = 2000
# Built-in number formats that show a date or a time.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _texts(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    out = []
    with archive.open("xl/sharedStrings.xml") as f:
        for _, e in iterparse(f):
            if _tag(e) == "si":
                out.append("".join(t.text or "" for t in e.iter() if _tag(t) == "t"))
                e.clear()
    return out


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in archive.namelist():
        return set()
    custom, styles, inside = set(), set(), False
    with archive.open("xl/styles.xml") as f:
        index = 0
        for event, e in iterparse(f, events=("start", "end")):
            name = _tag(e)
            if name == "cellXfs":
                inside = event == "start"
            elif name == "numFmt" and event == "end":
                code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode", ""))
                if re.search("[ymdhs]", code, re.I):
                    custom.add(int(e.get("numFmtId")))
            elif name == "xf" and event == "end" and inside:
                fmt = int(e.get("numFmtId", 0))
                if fmt in _DATE_FORMATS or fmt in custom:
                    styles.add(index)
                index += 1
    return styles


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    targets = {}
    with archive.open("xl/_rels/workbook.xml.rels") as f:
        for _, e in iterparse(f):
            if _tag(e) == "Relationship":
                targets[e.get("Id")] = e.get("Target").removeprefix("/").removeprefix("xl/")
    out = []
    with archive.open("xl/workbook.xml") as f:
        for _, e in iterparse(f):
            if _tag(e) == "sheet":
                ref = next(v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "id" and k != "id")
                out.append((e.get("name"), f"xl/{targets[ref]}"))
    return out


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _value(cell, texts: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _tag(t) == "t")
    raw = next((v.text for v in cell if _tag(v) == "v"), None)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return texts[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        moment = datetime(1899, 12, 30) + timedelta(seconds=round(float(raw) * 86400))
        return str(moment.date() if moment.time() == datetime.min.time() else moment)
    if kind == "n" and re.fullmatch(r"-?\d+\.0+", raw):
        return raw.split(".")[0]
    return raw


def _rows(archive: zipfile.ZipFile, part: str, texts: list[str], dates: set[int]) -> Iterator[tuple[int, list]]:
    with archive.open(part) as f:
        at = 0
        for _, e in iterparse(f):
            if _tag(e) != "row":
                continue
            at = int(e.get("r", at + 1))
            cells: list[str | None] = []
            for c in e:
                i = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (i + 1 - len(cells))
                cells[i] = _value(c, texts, dates)
            e.clear()
            if any(v is not None for v in cells):
                yield at, cells


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                texts, dates = _texts(archive), _date_styles(archive)
                for number, (sheet, part) in enumerate(_sheets(archive)):
                    pending = []
                    for at, cells in _rows(archive, part, texts, dates):
                        pending.append((path, sheet, number, at, cells))
                        if len(pending) == _BATCH:
                            yield pd.DataFrame(pending, columns=["file", "sheet", "sheet_no", "row_no", "cells"])
                            pending = []
                    if pending:
                        yield pd.DataFrame(pending, columns=["file", "sheet", "sheet_no", "row_no", "cells"])


def workbook_cells(files: DataFrame) -> DataFrame:
    """``file, sheet, sheet_no, row_no, cells`` of every non-empty row; ``files`` has ``path, content``."""
    return files.select("path", "content").mapInPandas(_parse, CELLS)


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the workbooks below ``path``."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True)
    return reader.load(path)


def sheet_headers(cells: DataFrame) -> DataFrame:
    """``file, sheet, header, row_no, sheet_no``: a name for each column of each sheet, from its first non-empty row.

    A repeated header is numbered (``x``, ``x_2``), a blank one over filled cells is named after its place
    (``column_4``); a column without header and cells has no name.
    """
    heads = cells.groupBy("file", "sheet").agg(
        F.min_by("cells", "row_no").alias("header"), F.min("row_no").alias("row_no"), F.min("sheet_no").alias("sheet_no")
    )
    # At most a row per column of a sheet.
    filled = cells.select("file", "sheet", F.posexplode("cells").alias("at", "cell")).filter("cell IS NOT NULL")
    filled = filled.groupBy("file", "sheet").agg(F.collect_set("at").alias("filled"), F.max("at").alias("last"))

    def name(i: Column) -> Column:
        own, before = F.get("header", i), F.slice("header", 1, i)
        again = F.size(F.filter(before, lambda h: h == own))
        blank = F.when(F.array_contains("filled", i), F.concat(F.lit("column_"), (i + 1).cast("string")))
        numbered = F.concat(own, F.when(again > 0, F.concat(F.lit("_"), (again + 1).cast("string"))).otherwise(F.lit("")))
        return F.when(own.isNull(), blank).otherwise(numbered)

    named = heads.join(filled, ["file", "sheet"])
    places = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: i.cast("int"))
    return named.select("file", "sheet", F.transform(places, name).alias("header"), "row_no", "sheet_no")


def workbook_regions(cells: DataFrame, positions: bool = False) -> tuple[dict[str, DataFrame], list[str]]:
    """One region per sheet name over all workbooks, as text columns in sheet order, and notes.

    With ``positions`` rows carry file, sheet and row number in the column ``AT``.
    Sheets without rows do not appear. Columns are found by name, so workbooks of one collection may
    order them differently. Only the distinct headers reach the driver.
    """
    headers = sheet_headers(cells)
    layouts = headers.groupBy("sheet", "header").agg(F.min("sheet_no").alias("n")).orderBy("n", "sheet", "header").collect()
    regions: dict[str, DataFrame] = {}
    for sheet in dict.fromkeys(r["sheet"] for r in layouts):
        names = list(dict.fromkeys(h for r in layouts if r["sheet"] == sheet for h in r["header"] if h is not None))
        marks = headers.filter(F.col("sheet") == sheet).select(F.col("file").alias("_f"), "header", F.col("row_no").alias("_h"))
        # A row per file on the side that is hashed; the cells are not sorted to meet it.
        body = cells.filter(F.col("sheet") == sheet).join(marks.hint("shuffle_hash"), F.col("file") == F.col("_f")).filter("row_no > _h")
        at = F.struct(
            "file", F.col("sheet_no").cast("bigint").alias("block"), F.col("row_no").cast("bigint").alias("row"), F.lit(0).cast("bigint").alias("part")
        )
        regions[sheet] = body.select(
            *[F.get("cells", (F.array_position("header", n) - 1).cast("int")).alias(n) for n in names],
            *([at.alias(AT)] if positions else []),
        )
    return regions, [] if regions else ["No sheet of the workbook has cells."]


def read_workbooks(spark: SparkSession, path: str, positions: bool = False) -> tuple[dict[str, DataFrame], list[str]]:
    """Regions of the workbooks below ``path``.

    The cells are parsed once and stored, because headers and every sheet read them again.
    """
    return workbook_regions(materialize(workbook_cells(workbook_files(spark, path)), "workbook"), positions)
