"""Passages of a benchmark in documents, found by winnowed fingerprints and extended to whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.llm.table import KeyFilter, ready, saved
from rowmill.llm.words import LETTERS_AND_DIGITS, Words, grams, inside, words

# A hit is a run of so many consecutive words of an item.
WINDOW_WORDS = 10
# Words of a fingerprint. Of the WINDOW_WORDS - GRAM_WORDS + 1 fingerprints in a window the smallest is kept, which
# depends on the window alone: equal windows keep equal fingerprints, so every shared window is found.
GRAM_WORDS = 5

_CANDIDATE = "struct<mark:bigint,whole:bigint,start:int,n:int,words:string>"


def _winnowed(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest fingerprint of each window (the last of equal ones) and its place in the window."""
    marks = grams(hashes, gram)
    m = max(0, len(hashes) - window + 1)
    best, place = marks[:m].copy(), np.zeros(m, np.int64)
    for o in range(1, window - gram + 1):
        other = marks[o : o + m]
        better = other <= best
        best[better] = other[better]
        place[better] = o
    return best, place


def _short(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of whole runs of ``n`` words, apart from the winnowed ones."""
    return grams(hashes, n) ^ np.uint64(0xA5A5A5A5A5A5A5A5)


def _item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """``item, n, mark, whole, words``: each window of each item, with its fingerprint and the hash of all its words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), LETTERS_AND_DIGITS):
                hashes, bounds = w.hashes(), w.bounds
                best, _ = _winnowed(hashes, window, gram)
                full = grams(hashes, window)
                item, n, mark, whole, text = [], [], [], [], []
                for r in range(w.rows):
                    first, last = int(bounds[r]), int(bounds[r + 1])
                    size = min(window, last - first)
                    if not size:
                        continue
                    short = _short(hashes[first:last], size) if size < window else None
                    for i in range(first, last - size + 1):
                        item.append(w.row + r)
                        n.append(size)
                        mark.append(int((best[i] if short is None else short[0]).view(np.int64)))
                        whole.append(int((full[i] if short is None else short[0]).view(np.int64)))
                        text.append(w.text(i, i + size))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(item, pa.int64())), pa.array(n, pa.int32()), pa.array(mark, pa.int64()),
                     pa.array(whole, pa.int64()), pa.array(text, pa.string())],
                    names=["item", "n", "mark", "whole", "words"],
                )

    own = T.StructType([T.StructField("item", items.schema[0].dataType)])
    return items.mapInArrow(rows, T.StructType([*own, *T.StructType.fromDDL("n int, mark bigint, whole bigint, words string")]))


def _candidates(w: Words, window: int, gram: int, lengths: list[int], may: KeyFilter, may_whole: KeyFilter) -> list[list[dict]]:
    """Of each row, the windows whose fingerprint, extended to the whole window, an item may have."""
    hashes, of, bounds = w.hashes(), w.of, w.bounds
    out: list[list[dict]] = [[] for _ in range(w.rows)]

    def add(at: int, n: int, mark: np.uint64, whole: np.uint64) -> None:
        row = int(of[at])
        out[row].append({
            "mark": int(mark.view(np.int64)), "whole": int(whole.view(np.int64)), "start": at - int(bounds[row]), "n": n, "words": w.text(at, at + n),
        })

    best, _ = _winnowed(hashes, window, gram)
    if len(best):
        full = grams(hashes, window)
        for at in np.flatnonzero(inside(of, window) & may(best) & may_whole(full)).tolist():
            add(at, window, best[at], full[at])
    for n in lengths:
        marks = _short(hashes, n)
        for at in np.flatnonzero(inside(of, n) & may(marks)).tolist():
            add(at, n, marks[at], marks[at])
    return out


def _marked(docs: DataFrame, window: int, gram: int, lengths: list[int], filters: tuple[KeyFilter, KeyFilter]) -> DataFrame:
    """``row, id, text_key, n_words, candidates`` of every document; ``row`` is different for each."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(filters)
    kind = pa.list_(pa.struct([("mark", pa.int64()), ("whole", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.string())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 40
        for batch in batches:
            for w in words(batch.column(2), LETTERS_AND_DIGITS):
                found = _candidates(w, window, gram, lengths, *sent.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(no, no + w.rows), pa.int64()), batch.column(0).slice(w.row, w.rows),
                     batch.column(1).slice(w.row, w.rows), pa.array(np.diff(w.bounds), pa.int64()), pa.array(found, kind)],
                    names=["row", "id", "text_key", "n_words", "candidates"],
                )
                no += w.rows

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema[0].dataType)])
    schema = T.StructType([*schema, *T.StructType.fromDDL(f"text_key bigint, n_words bigint, candidates array<{_CANDIDATE}>")])
    return docs.mapInArrow(rows, schema)


def covered_words(spans: Column) -> Column:
    """Words in the union of ``start, n`` spans."""

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["n"]
        return F.struct(
            (acc["total"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("total"),
            F.greatest(acc["end"], end).alias("end"),
        )

    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")), add, lambda a: a["total"])


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW_WORDS,
    gram: int = GRAM_WORDS,
) -> DataFrame:
    """``id, text_key, n_words, n_hit, spans, items`` for every row of ``docs``.

    Words are runs of ASCII digits, letters (A-Z lowered) and of all that is not ASCII. A window is ``window``
    consecutive words of an item; an item of fewer words, but not none, is one window. ``spans`` are the
    windows found in the document as word positions and lengths, ``n_hit`` the words inside any of them, ``items``
    the items that a found window belongs to, as sorted strings. ``text_key`` is the 64-bit hash of the text,
    by which rows can be found again.

    Winnowing keeps the smallest fingerprint of ``gram`` words of each window, so documents and items that share
    a window share its fingerprint. Windows of documents whose fingerprint passes a bit filter of the items' ones, and
    whose extension to all words passes another (both of bounded size), are joined to the items' windows on both and
    compared word by word: hits are exact. A fingerprint that many items and documents share without sharing a
    window so makes no pairs. Documents without a candidate never leave their task.

    NULL texts have no words. NULL item ids count for hits and are not listed. Repeated rows and ids get a
    row each. Empty tables: no rows, or no hits.
    """
    spark = ready(docs.sparkSession)
    windows = saved(_item_windows(items.select(item_column, item_text_column), window, gram), "item-windows")
    marks = windows.select("mark", "whole", "n").distinct()
    lengths = [r["n"] for r in marks.where(F.col("n") < window).select("n").distinct().collect()]
    known = marks.count()
    filters = KeyFilter.of(marks, "mark", known), KeyFilter.of(marks, "whole", known)
    picked = docs.select(F.col(f"`{id_column}`"), F.xxhash64(f"`{text_column}`"), F.col(f"`{text_column}`"))
    marked = saved(_marked(picked, window, gram, sorted(lengths), filters), "marked-documents")
    spots = marked.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    distinct = windows.select("mark", "whole", "n", "words").distinct()
    # Equal words have equal keys; unequal ones with equal keys are told apart by the words.
    hits = spots.join(distinct, ["mark", "whole", "n", "words"]).select("row", "start", "n", "words")
    owned = hits.join(windows.select("words", "item").distinct(), "words")
    per_row = owned.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"),
    )
    none = F.expr("cast(array() as array<struct<start:int,n:int>>)")
    return (
        marked.drop("candidates")
        .join(per_row, "row", "left")
        .select(
            "id", "text_key", "n_words",
            F.coalesce(covered_words(F.col("spans")), F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("spans", none).alias("spans"),
            F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        )
    )


def document_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of ``leaks`` per document."""
    return leaks(docs, items).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    bad = leaks(docs, items, id_column, text_column).where("n_hit > 0").select("id", "text_key").distinct()
    match = F.col(f"`{id_column}`").eqNullSafe(bad["id"]) & (F.xxhash64(f"`{text_column}`") == bad["text_key"])
    return docs.join(bad, match, "left_anti")
