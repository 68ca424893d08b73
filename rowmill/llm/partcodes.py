"""Vectors as codes of their parts: integer codebooks, nearest entries found with the help of fixed pivots."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.attach import FREQUENT, attach
from rowmill.llm.table import ready, saved

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
# Pivots of each part position.
PIVOTS = 4
# Rows that are worked on at a time.
BLOCK_ROWS = 4096
# Slack of the bounds, far above what square roots in doubles can be off.
SLACK, SLACK_SHARE = 1e-6, 1e-12


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def largest(width: int) -> int:
    """Integer components are clipped to this, so that squared distances of ``width`` components fit into 64 bits."""
    return min((1 << 31) - 1, math.isqrt((1 << 62) // max(width, 1)) // 2)


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(SCALE * x), filled up with zeros to ``width``."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    top = largest(width)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.clip(flat, -top, top).astype(np.int64)
    return out


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows that stand side by side."""
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def choose_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: each next one has the largest sum of distances to those before."""
    chosen = [0]
    while len(chosen) < min(count, len(entries)):
        sums = sum(np.sqrt(squared(entries, entries[c]).astype(float)) for c in chosen)
        sums[chosen] = -1
        chosen.append(int(np.argmax(sums)))
    return entries[chosen]


@dataclass
class Codebooks:
    """Of each part position: entries and fixed pivots, as integers."""

    entries: np.ndarray  # part, entry, place
    pivots: np.ndarray  # part, pivot, place

    @classmethod
    def start(cls, first: np.ndarray, parts: int = PARTS) -> Codebooks:
        """From the vectors whose parts are the first entries."""
        entries = first.reshape(len(first), parts, first.shape[1] // parts).transpose(1, 0, 2)
        return cls(entries, np.stack([choose_pivots(e) for e in entries]))

    def to_pivots(self, rows: np.ndarray) -> np.ndarray:
        """Squared distances of each part to the pivots of its position: rows x parts x pivots."""
        parts, count, width = self.pivots.shape
        cut = rows.reshape(len(rows), parts, 1, width)
        return squared(cut, self.pivots[None])

    def nearest(self, rows: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry of each part and its squared distance (ties to the lower entry), and how many distances were evaluated.

        A part's distance to an entry is at least the difference of their distances to a pivot. Entries are tried
        from the lowest bound on, until the next bound is above the best distance; distances are exact integers, and
        the bounds have slack for rounding.
        """
        n, (parts, count, width) = len(rows), self.entries.shape
        codes, errors, evaluated = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64), 0
        for j in range(parts):
            x, entries = rows[:, j * width : (j + 1) * width], self.entries[j]
            own = np.sqrt(to_pivots[:, j].astype(float))  # rows x pivots
            theirs = np.sqrt(squared(self.pivots[j][:, None], entries[None]).astype(float))  # pivots x entries
            bound = np.zeros((n, count))
            for p in range(len(theirs)):
                gap = np.abs(own[:, p, None] - theirs[p])
                np.maximum(bound, gap - SLACK - SLACK_SHARE * (own[:, p, None] + theirs[p]), out=bound)
            bound *= bound * (1 - SLACK_SHARE)
            order = np.argsort(bound, axis=1, kind="stable")
            best, arg = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
            open_ = np.arange(n)
            for turn in range(count):
                e = order[open_, turn]
                need = bound[open_, e] <= best[open_]
                open_, e = open_[need], e[need]
                if not len(open_):
                    break
                d = squared(x[open_], entries[e])
                evaluated += len(open_)
                better = (d < best[open_]) | ((d == best[open_]) & (e < arg[open_]))
                best[open_[better]], arg[open_[better]] = d[better], e[better]
            codes[:, j], errors[:, j] = arg, best
        return codes, errors, evaluated

    def moved(self, sums: dict[tuple[int, int, int], tuple[int, int]]) -> Codebooks:
        """Every used entry replaced by the floored mean of its parts; ``sums`` tells sum and count by part, entry and place."""
        entries = self.entries.copy()
        for at, (total, n) in sums.items():
            entries[at] = total // n
        return Codebooks(entries, self.pivots)

    def sha256(self) -> str:
        """Digest of all components as decimal text, by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch], width: int, pivots: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Stored rows as arrays: integer vectors and distances to pivots."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            rows = part.column("ints").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, width)
            yield part, rows, part.column("to_pivots").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1, pivots)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width), pa.int32()), pa.array(values.ravel(), kind))


def prepare(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Stored ``id, label, ints, to_pivots`` of the usable rows: distances to the fixed pivots are computed here, once."""
    width = books.entries.shape[0] * books.entries.shape[2]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = integers(batch.column("vector"), width)
            away = books.to_pivots(ints).reshape(len(ints), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), _lists(ints, pa.int32()), _lists(away, pa.int64())],
                names=["id", "label", "ints", "to_pivots"],
            )

    schema = f"id {kinds['id']}, label {kinds['label']}, ints array<int>, to_pivots array<bigint>"
    return saved(rows.mapInArrow(apply, schema), "part-rows")


def improve(stored: DataFrame, books: Codebooks) -> tuple[Codebooks, int]:
    """One round: codebooks after every part has been assigned, and the distances that were evaluated.

    A task sends the sums of its rows once, a row per component of the codebooks; so many come to the driver too.
    """
    parts, count, size = books.entries.shape
    pivots = books.pivots.shape[1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, used, evaluated = np.zeros((parts, count, size), np.int64), np.zeros((parts, count), np.int64), 0
        for _, rows, away in _blocks(batches, parts * size, pivots):
            codes, _, tried = books.nearest(rows, away)
            evaluated += tried
            for j in range(parts):
                used[j] += np.bincount(codes[:, j], minlength=count)
                np.add.at(sums[j], codes[:, j], rows[:, j * size : (j + 1) * size])
        part, entry = np.nonzero(used)
        place = np.tile(np.arange(size), len(part))
        part, entry = np.repeat(part, size), np.repeat(entry, size)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(np.append(part, -1), pa.int32()), "entry": pa.array(np.append(entry, 0), pa.int32()),
            "place": pa.array(np.append(place, 0), pa.int32()), "total": pa.array(np.append(sums[part, entry, place], evaluated), pa.int64()),
            "n": pa.array(np.append(used[part, entry], 0), pa.int64()),
        })

    made = stored.select("ints", "to_pivots").mapInArrow(apply, "part int, entry int, place int, total bigint, n bigint")
    # Sums of sums as decimals: 64 bits hold those of a task.
    total = F.sum(F.col("total").cast("decimal(20, 0)")).alias("total")
    found = {(r["part"], r["entry"], r["place"]): (int(r["total"]), r["n"]) for r in made.groupBy("part", "entry", "place").agg(total, F.sum("n").alias("n")).collect()}
    evaluated, _ = found.pop((-1, 0, 0), (0, 0))
    return books.moved(found), evaluated


def encode(stored: DataFrame, books: Codebooks) -> DataFrame:
    """``id, label, code, error`` of each row: two hex digits per part, and the squared distances summed."""
    parts, _, size = books.entries.shape
    pivots = books.pivots.shape[1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, away in _blocks(batches, parts * size, pivots):
            codes, errors, _ = books.nearest(rows, away)
            text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors.sum(axis=1), pa.int64())],
                names=["id", "label", "code", "error"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in stored.schema.fields}
    return stored.mapInArrow(apply, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def _rounded(length: int, parts: int) -> int:
    return max(parts, -(-length // parts) * parts)


def compress(
    df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, frequent: int = FREQUENT,
) -> DataFrame:
    """``id_column, code, error, label_error, codebooks_sha256`` of every usable row.

    Vectors that are NULL or have NULL or non-finite components are dropped. Shorter vectors are filled up with zeros
    to the longest one's length, and that to a multiple of ``parts``. Codebooks start as the parts of the ``entries``
    smallest ids (NULL ids last, equal ids by their vectors; with fewer rows there are fewer entries) and move for
    ``rounds`` rounds. Integers too large for 64-bit distances are clipped (see ``largest``; components of thousands).
    Repeated rows count each. No usable rows: no rows. Other columns are left out.

    ``label_error`` sums ``error`` over rows of equal labels, NULL ones together; a label of a large part of all rows is
    attached by broadcast. The rows are stored once with their distances to the pivots, and each round scans them
    without a shuffle of rows: what travels are the sums per entry, what is sent to tasks are the codebooks.
    """
    ready(df.sparkSession)
    rows = df.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").alias("label"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector")
    ).where(usable(F.col("vector")))
    longest = rows.agg(F.max(F.size("vector")).alias("n")).first()["n"]
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow().column("vector").combine_chunks()
    width = _rounded(longest or 0, parts)
    start = integers(first, width) if len(first) else np.zeros((1, width), np.int64)
    books = Codebooks.start(start, parts)
    stored = prepare(rows, books)
    for _ in range(rounds):
        books, _ = improve(stored, books)
    coded = saved(encode(stored, books), "part-codes")
    facts = saved(coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")), "part-labels")
    out = attach(coded, "label", facts, ["label_error"], null_is_key=True, frequent=frequent)
    return out.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
