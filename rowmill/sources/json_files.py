"""JSON documents: arrays of objects, objects of arrays, one object per line.

The shape is decided for each file of a folder, so that a folder may hold several.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, StructType

from rowmill.sources.delimited import AT, place

NO_SHAPE = "No JSON records found: expected an array of objects, an object of arrays, or an object per line."
BAD_LINE = "Some lines are no JSON objects."
CORRUPT = "_corrupt_record"


def _reader(spark: SparkSession, whole: bool):
    # Looking through sub-folders also keeps folder names from turning into columns.
    return spark.read.option("recursiveFileLookup", True).option("multiLine", whole)


def _local(uri: str) -> str:
    """A file's address as the readers take it (they do not decode it)."""
    return unquote(uri) if urlsplit(uri).scheme else uri


def _kinds(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by what their first two non-blank lines say: ``lines``, ``array``, ``object``, ``record`` or ``none``.

    A first line that is a whole object followed by another line can only be line-delimited (reading such
    a file as one document would silently keep its first object only); a single such line (``record``) may
    still be an object of arrays. There is a row per file, as in the listing that every scan makes.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = lines.select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("f"), at.alias("at")).filter("v <> ''")
    heads = lines.withColumn("n", F.row_number().over(W.partitionBy("f").orderBy("at"))).filter("n <= 2")
    first, whole = F.substring("v", 1, 1), F.try_parse_json("v").isNotNull()
    per_file = heads.groupBy("f").agg(
        F.max(F.when(F.col("n") == 1, first)).alias("first"), F.max(F.when(F.col("n") == 1, whole)).alias("whole"), F.max("n").alias("lines")
    )
    found: dict[str, list[str]] = {}
    for r in per_file.orderBy("f").toLocalIterator():
        if r["first"] == "[":
            kind = "array"
        elif r["first"] != "{":
            kind = "none"
        elif r["whole"]:
            kind = "lines" if r["lines"] > 1 else "record"
        else:
            kind = "object"
        found.setdefault(kind, []).append(_local(r["f"]))
    return found


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _good(df: DataFrame, notes: list[str], note: str) -> DataFrame:
    """Rows that were read; files with others are noted by name."""
    if CORRUPT not in df.columns:
        return df
    if df.columns == [CORRUPT]:
        return df.drop(CORRUPT)
    df = df.withColumn("_file", F.col("_metadata.file_path"))
    # The scan does not serve the corrupt column alone, so an empty slice of another one goes with it.
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("_file", CORRUPT)]
    mark = F.concat_ws("", F.lit(""), *(F.to_json(F.struct(c)).substr(1, 0) for c in rest[:1]))
    bad = df.filter(F.col(CORRUPT).isNotNull()).select("_file", mark.alias("mark")).groupBy("_file").agg(F.max("mark"))
    names = sorted(_name(_local(r["_file"])) for r in bad.collect())
    notes += [f"{n}: {note}" for n in names]
    return df.filter(F.col(CORRUPT).isNull()).drop("_file", CORRUPT)


def _union(frames: list[DataFrame]) -> DataFrame:
    """Frames by column name; a column of several types becomes text."""
    types: dict[str, set[str]] = {}
    for df in frames:
        for c, t in df.dtypes:
            types.setdefault(c, set()).add(t)
    mixed = {c for c, t in types.items() if len(t) > 1}

    def text(df: DataFrame) -> DataFrame:
        nested = {c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}
        return df.select(
            *[
                (F.to_json(F.col(f"`{c}`")) if c in nested else F.col(f"`{c}`").cast("string")).alias(c) if c in mixed else F.col(f"`{c}`")
                for c in df.columns
            ]
        )

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(text, frames))


def _any_filled(names: list[str]) -> Column:
    return reduce(Column.__or__, [F.col(f"`{n}`").isNotNull() for n in names], F.lit(False))


def _is_list(field) -> bool:
    return isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StructType)


def _read(spark: SparkSession, path: str, positions: bool = False) -> tuple[set[str], dict[str, DataFrame], list[str]]:
    """Shapes found, regions, and notes on files without a shape; ``positions`` adds the column ``AT`` to the rows."""

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn(AT, place()) if positions else rows

    kinds = _kinds(spark, path)
    shapes: set[str] = set()
    regions: dict[str, list[DataFrame]] = {}
    notes = [f"{_name(f)}: {NO_SHAPE}" for f in kinds.get("none", [])]
    if "array" in kinds:
        rows = _good(_reader(spark, True).json(kinds["array"]), notes, NO_SHAPE)
        if rows.columns:
            shapes.add("array")
            regions.setdefault("default", []).append(placed(rows))
        else:
            notes += [f"{_name(f)}: {NO_SHAPE}" for f in kinds["array"]]
    lined = list(kinds.get("lines", []))
    for kind in ("object", "record"):
        if kind not in kinds:
            continue
        rows = _reader(spark, True).json(kinds[kind]).withColumn("_file", F.col("_metadata.file_path"))
        lists = [f.name for f in rows.schema.fields if _is_list(f)]
        others = [c for c in rows.columns if c not in (*lists, "_file")]
        fits = _any_filled(lists) & ~_any_filled(others)
        shaped = {_local(r["_file"]) for r in rows.select("_file", fits.alias("fits")).filter("fits").toLocalIterator()}
        rest = [f for f in kinds[kind] if f not in shaped]
        if shaped:
            shapes.add("object")
            whole = _reader(spark, True).json(sorted(shaped))
            for f in whole.columns:
                regions.setdefault(f, []).append(_elements(whole, f, positions))
        if kind == "record":
            lined += rest
        else:
            notes += [f"{_name(f)}: {NO_SHAPE}" for f in rest]
    if lined:
        rows = _good(_reader(spark, False).json(sorted(lined)), notes, BAD_LINE)
        if rows.columns:
            shapes.add("lines")
            regions.setdefault("default", []).append(placed(rows))
        else:
            notes += [f"{_name(f)}: {NO_SHAPE}" for f in lined]
    return shapes, {name: _union(frames) for name, frames in regions.items()}, notes


def _elements(whole: DataFrame, name: str, positions: bool) -> DataFrame:
    """The objects of a list, a row each."""
    if not positions:
        return whole.select(F.inline(F.col(f"`{name}`")))
    rows = whole.select(place().alias(AT), F.posexplode(F.col(f"`{name}`")).alias("_i", "_v"))
    at = F.struct(F.col(f"{AT}.file"), F.col(f"{AT}.block"), F.col(f"{AT}.row"), F.col("_i").cast("bigint").alias("part"))
    return rows.where("_v IS NOT NULL").select("_v.*", at.alias(AT))


def json_shape(spark: SparkSession, path: str) -> str:
    """``array``, ``object``, ``lines`` or ``none``; ``mixed`` for a folder that holds several."""
    shapes = _read(spark, path)[0]
    return shapes.pop() if len(shapes) == 1 else "mixed" if shapes else "none"


def read_json(spark: SparkSession, path: str, positions: bool = False) -> tuple[dict[str, DataFrame], list[str]]:
    """Regions of a document or folder and notes; a file that cannot be read gives a note, not an error.

    Files of records, as arrays or by line, make up the region ``default``; each list of an object of
    arrays is a region of its name.
    """
    _, regions, notes = _read(spark, path, positions)
    return regions, notes or ([] if regions else [NO_SHAPE])


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, the form in which they are profiled and loaded."""
    return df.select(
        *[
            F.to_json(F.col(f"`{c}`")).alias(c) if c != AT and t.startswith(("array", "map", "struct")) else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )
