"""Removal of repeated passages by overlapping windows of lines, or of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.attach import FREQUENT, attach
from rowmill.llm.table import fresh, saved

WINDOW_LINES = 3
# Words of a passage of sentences at least.
PASSAGE_WORDS = 50
# A piece starts after the end of a sentence or line, where the next word starts: so each but the first has a word.
_PIECE = r"(?<=[.!?]\s)(?=\S)|(?<=\n)(?=\S)"


def _line_keys(lines: Column) -> Column:
    """Two independent 64-bit hashes of each line: equal lines, and in practice only those, agree."""
    return F.transform(lines, lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b")))


def _windows(keys: Column, width: int) -> Column:
    """Position and key of each window; a text of fewer lines is one window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(keys) - width, F.lit(0)))

    def window(i: Column) -> Column:
        part = F.slice(keys, i + 1, F.lit(width))
        return F.struct(
            i.cast("int").alias("pos"),
            F.xxhash64(F.lit(3), part["a"]).alias("a"),
            F.xxhash64(F.lit(4), part["b"]).alias("b"),
        )

    return F.transform(starts, window)


def later_positions(df: DataFrame, id_column: str, text_column: str, width: int = WINDOW_LINES) -> DataFrame:
    """``id, pos`` (array of window starts) of the windows that occurred before, per document that has any.

    Order is (id, position). See :func:`_later` for windows that many documents share.
    """
    lines = F.split(F.col(f"`{text_column}`"), "\n", -1)
    spots = (
        df.where(F.col(f"`{id_column}`").isNotNull() & (F.col(f"`{text_column}`") != ""))
        .select(F.col(f"`{id_column}`").alias("id"), _line_keys(lines).alias("keys"))
        .select("id", F.explode(_windows(F.col("keys"), width)).alias("w"))
        .select("id", "w.pos", "w.a", "w.b")
    )
    return _later(spots).groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("pos"))


def _later(spots: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The rows of ``id, pos, a, b`` (and more) whose window ``a, b`` occurred before.

    The first occurrence of each window is a minimum that is combined on the map side, so that a window held by a third
    of all documents sends one row per task. Only the firsts of windows that repeat are then looked up, those of
    the most frequent ones in every task, so that no task gets all rows of a window.
    """
    firsts = spots.groupBy("a", "b").agg(F.min(F.struct("id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    known = saved(firsts.select(F.struct("a", "b").alias("window"), "first", "n"), "first-windows")
    met = attach(spots.withColumn("window", F.struct("a", "b")), "window", known, ["first"], frequent=frequent)
    return met.where(F.struct("id", "pos") > F.col("first")).drop("window", "first")


def drop_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WINDOW_LINES) -> DataFrame:
    """Every row, with the lines of repeated windows removed from the text and ``lines_removed`` added.

    All windows of ``width`` consecutive lines (a text of fewer lines is one window) are compared over
    the whole table; each window's occurrences after its first, in order of (id, position), are covered,
    overlapping covers merge, and covered lines go. A text whose lines all go becomes empty. NULL and
    empty texts stay as they are and take no part; rows with a NULL id keep their text and take no part.
    Rows that repeat an id are one document to the order: of two windows at the same id and position
    neither is later, so such rows keep their text unless an earlier id has it. A column called ``lines_removed``
    is replaced; any other column is kept.
    """
    at, lines = fresh(df, "covered_from", "lines")
    later = later_positions(df, id_column, text_column, width).select(
        F.col("id").alias(f"{at}_id"), F.col("pos").alias(at)
    )
    text = F.col(f"`{text_column}`")
    joined = df.join(later, F.col(f"`{id_column}`") == F.col(f"{at}_id"), "left")
    split = joined.withColumn(lines, F.when(F.col(at).isNotNull(), F.split(text, "\n", -1)))
    # What lies between the covers: from the end of one to the start of the next, if that is later.
    gaps = F.zip_with(
        F.concat(F.array(F.lit(-width)), at),
        F.concat(at, F.array(F.size(lines))),
        lambda before, after: F.struct(
            (before + width).alias("start"), F.greatest(after - before - width, F.lit(0)).alias("n")
        ),
    )
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col(lines), g["start"] + 1, g["n"])))
    hit = F.col(at).isNotNull()
    out = []
    for c in df.columns:
        if c == text_column:
            out.append(F.when(hit, F.array_join(kept, "\n")).otherwise(text).alias(c))
        elif c.lower() != "lines_removed":
            out.append(F.col(f"`{c}`"))
    left = F.aggregate(gaps, F.lit(0), lambda total, g: total + g["n"])
    removed = F.when(hit, F.size(lines) - left).otherwise(0).cast("bigint")
    return split.select(*out, removed.alias("lines_removed"))


def _pieces(text: Column) -> Column:
    """A text cut behind sentences and lines; the pieces put together are the text."""
    return F.split(text, _PIECE, -1)


def _word_count(piece: Column) -> Column:
    return F.size(F.filter(F.split(piece, r"\s+"), lambda w: w != ""))


def _passages(counts: Column, keys: Column, words: int) -> Column:
    """``pos, size, a, b`` of the shortest run of pieces from each piece on that has ``words`` words; none where too few follow.

    ``counts`` are the words of the pieces, ``keys`` their hashes; both must be stored columns, as they are looked at
    for each piece. Every piece but the first has a word, so ``words + 1`` pieces are always enough to look at.
    """

    def run(i: Column) -> Column:
        def add(acc: Column, n: Column) -> Column:
            open_ = acc["sum"] < words
            return F.struct(
                F.when(open_, acc["sum"] + n).otherwise(acc["sum"]).alias("sum"), F.when(open_, acc["size"] + 1).otherwise(acc["size"]).alias("size")
            )

        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("size"))
        size = F.aggregate(F.slice(counts, i + 1, F.lit(words + 1)), start, add, lambda acc: F.when(acc["sum"] >= words, acc["size"]))
        return F.struct(i.cast("int").alias("pos"), size.cast("int").alias("size"))

    def passage(p: Column) -> Column:
        part = F.slice(keys, p["pos"] + 1, p["size"])
        return F.struct(p["pos"], p["size"], F.xxhash64(F.lit(5), part["a"]).alias("a"), F.xxhash64(F.lit(6), part["b"]).alias("b"))

    runs = F.transform(F.sequence(F.lit(0), F.size(keys) - 1), run)
    return F.transform(F.filter(runs, lambda p: p["size"].isNotNull()), passage)


def drop_passages(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = PASSAGE_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """Every row, with repeated runs of sentences of ``words`` words or more removed and ``pieces_removed`` added.

    Texts are cut behind ``.``, ``!`` or ``?`` with a blank, and behind line ends. From each piece on, the shortest run of
    pieces with ``words`` words is a window; trailing blanks do not tell windows apart. As in :func:`drop_repeats`, all
    windows after the first, in order of (id, position), are covered over the whole table, however lines lie, and
    covered pieces go. So every repeated passage of that many words that starts with a sentence or line is cut, up to
    its last whole window. NULL and empty texts and rows with a NULL id stay as they are; rows that repeat an id are
    one document to the order. A column called ``pieces_removed`` is replaced; any other column is kept.
    """
    at, pieces = fresh(df, "covered", "pieces")
    text = F.col(f"`{text_column}`")
    spots = (
        df.where(F.col(f"`{id_column}`").isNotNull() & (text != ""))
        .select(F.col(f"`{id_column}`").alias("id"), _pieces(text).alias("pieces"))
        .select(
            "id", F.transform("pieces", _word_count).alias("counts"),
            _line_keys(F.transform("pieces", lambda x: F.rtrim(F.translate(x, "\n", " ")))).alias("keys"),
        )
        .select("id", F.explode(_passages(F.col("counts"), F.col("keys"), words)).alias("w"))
        .select("id", "w.pos", "w.size", "w.a", "w.b")
    )
    covers = _later(spots, frequent).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("pos", "size"))).alias(at))
    joined = df.join(covers.withColumnRenamed("id", f"{at}_id"), F.col(f"`{id_column}`") == F.col(f"{at}_id"), "left")
    split = joined.withColumn(pieces, F.when(F.col(at).isNotNull(), _pieces(text)))
    # Windows that start later end later or at the same place, so what lies between neighbours is uncovered.
    ends = F.transform(at, lambda w: w["pos"] + w["size"])
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), ends),
        F.concat(F.transform(at, lambda w: w["pos"]), F.array(F.size(pieces))),
        lambda start, stop: F.struct(start.alias("start"), F.greatest(stop - start, F.lit(0)).alias("n")),
    )
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col(pieces), g["start"] + 1, g["n"])))
    hit = F.col(at).isNotNull()
    out = [
        F.when(hit, F.array_join(kept, "")).otherwise(text).alias(c) if c == text_column else F.col(f"`{c}`")
        for c in df.columns if c.lower() != "pieces_removed"
    ]
    left = F.aggregate(gaps, F.lit(0), lambda total, g: total + g["n"])
    return split.select(*out, F.when(hit, F.size(pieces) - left).otherwise(0).cast("bigint").alias("pieces_removed"))
