"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.table import fresh, ready, replace
from rowmill.llm.words import BETWEEN_SPACES, cut, grams, hashed, words

# Weights; the last one is the bias.
BITS = 18
# Labelled rows that training reads at most (in expectation), drawn by a hash of the id.
SAMPLE_ROWS = 24_000
# Learners that each see a part of the sample; their weights are averaged.
LEARNERS = 8
EPOCHS = 4
# Of the per-coordinate steps: rate, smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.001, 0.001

# Bytes by shape: lower case and all that is not ASCII, upper case, digits; everything else is its own shape.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("a") : ord("z") + 1] = SHAPE[0x80:] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, slots (5 per word) and word bounds of the rows of each block.

    A word gives itself, the pair with the word before it, its shape (runs of lower case, upper case and digits as one
    character each), the pair of shapes, and whether it repeats the word before.
    """
    top = np.uint64(64 - bits)
    for w in words(texts, BETWEEN_SPACES, lower=False):
        n = len(w.starts)
        if not n:
            yield w.row, np.empty((0, 5), np.int64), w.bounds
            continue
        own = w.hashes()
        shape = SHAPE[w.data]
        new = np.ones(len(shape), bool)
        new[1:] = shape[1:] != shape[:-1]
        new[w.starts] = True
        place = np.cumsum(new) - 1
        shapes = hashed(shape[new], place[w.starts], place[w.ends - 1] + 1)
        first = np.zeros(n, bool)
        first[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
        slots = np.empty((n, 5), np.int64)
        slots[:, 0] = own >> top
        slots[:, 2] = (shapes ^ np.uint64(0x5BD1E995)) * np.uint64(0x9E3779B97F4A7C15) >> top
        for column, values in ((1, own), (3, shapes)):
            pairs = np.empty(n, np.uint64)
            pairs[0] = values[0]
            pairs[1:] = grams(values, 2)
            pairs[first] = values[first] * np.uint64(0xD6E8FEB86659FD93)
            slots[:, column] = pairs >> top
        same = np.zeros(n, bool)
        same[1:] = own[1:] == own[:-1]
        slots[:, 4] = np.where(same & ~first, 1, 2)
        yield w.row, np.minimum(slots, (1 << bits) - 2), w.bounds


def _vectors(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct slots and their values of each row: shares of the row's words, and the bias."""
    bias = (1 << BITS) - 1
    out: list = [None] * len(texts)
    for row, slots, bounds in features(texts):
        for r in range(len(bounds) - 1):
            part = slots[bounds[r] : bounds[r + 1]].ravel()
            index, counts = np.unique(part, return_counts=True)
            values = counts * (5.0 / max(1, len(part)))
            out[row + r] = (np.append(index, bias), np.append(values, 1.0))
    return out


def _learn(texts: pa.Array, labels: np.ndarray) -> np.ndarray:
    """Weights after ``EPOCHS`` passes of follow-the-regularised-leader over one learner's rows, in the order given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def current(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rows = _vectors(texts)
    for _ in range(EPOCHS):
        for (i, x), y in zip(rows, labels, strict=True):
            w = current(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return current(np.arange(1 << BITS))


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on a sample of labelled rows, bounded by ``sample_rows``.

    Rows with a NULL id, text or label, or a label other than 0 and 1, are not learned from; an id with several
    labels is learned with each. Each learner takes the rows of its hash in order of (id, text), so results do
    not depend on how rows lie. Without labelled rows all weights are 0 and all scores a half.
    """
    spark = ready(docs.sparkSession)
    known = labels.where(F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y"))
    total = known.count()
    chance = F.pmod(F.xxhash64(F.lit(11), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    known = known.where(chance < sample_rows / max(1, total))
    rows = (
        docs.where(F.col(text_column).isNotNull())
        .where(F.pmod(F.xxhash64(F.lit(11), F.col(id_column)), F.lit(1 << 30)) / float(1 << 30) < sample_rows / max(1, total))
        .select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
        .join(known, "id")
        .withColumn("learner", F.pmod(F.xxhash64(F.lit(12), F.col("id")), F.lit(LEARNERS)).cast("int"))
    )

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending"), ("y", "ascending")])
        weights = _learn(table.column("text"), table.column("y").to_numpy().astype(float))
        used = np.flatnonzero(weights)
        return pa.table({"slot": pa.array(used, pa.int32()), "weight": pa.array(weights[used], pa.float64())})

    parts = rows.groupBy("learner").applyInArrow(learn, "slot int, weight double")
    # At most 2 ** BITS rows. Weights are summed as decimals: the sums do not depend on the order.
    summed = F.sum(F.col("weight").cast("decimal(28, 18)")).cast("double") / LEARNERS
    found = parts.groupBy("slot").agg(summed.alias("weight")).toArrow()
    weights = np.zeros(1 << BITS)
    weights[found.column("slot").to_numpy()] = found.column("weight").to_numpy()
    return Model(weights)


def score(df: DataFrame, model: Model, text_column: str = "text", name: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row: a sparse dot product of the whole text with the weights.

    NULL and empty texts get the bias alone. A column of the same name is replaced; any other is kept.
    """
    sent = df.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf("double")
    def apply(texts: pa.Array) -> pa.Array:
        weights = sent.value
        out = np.full(len(texts), weights[-1])
        for row, slots, bounds in features(texts):
            n = np.diff(bounds)
            # Summed row by row, so that a score does not depend on the rows beside it.
            sums = np.add.reduceat(np.append(weights[slots].sum(axis=1), 0.0), bounds[:-1])
            out[row : row + len(n)] += np.where(n > 0, sums / np.maximum(n, 1), 0.0)
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))), pa.float64())

    temporary, = fresh(df, "score_value")
    return replace(df.withColumn(temporary, apply(F.col(f"`{text_column}`"))), {name: F.col(temporary)}).drop(temporary)


def held_out(id_column: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 modulo 3 (NULL ids do not)."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` and ``predicted`` for every document, learned from rows that are not held out."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
