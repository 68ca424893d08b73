"""Documents drawn by how much they resemble a target: hashed features, noisy scores, and a distributed selection."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rowmill.llm.table import ready, saved
from rowmill.llm.words import LETTERS_AND_DIGITS, words
from rowmill.operators.ranking import numbered

BUCKETS = 10_000
SHARE_PERCENT = 25
SMALLEST_WORDS = 20
SEED = 7
# Pivots of a round of the selection; rows that end it.
PIVOTS = 15
FEW_ROWS = 4096
# Bytes of a word that are hashed for all words at once; the rest of longer ones goes word by word.
LONG_WORD = 64


def _crc_steps() -> np.ndarray:
    """The effect of each low byte on a CRC-32 register."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1).astype(np.uint32)
    return steps


STEPS = _crc_steps()


def _feed(register: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 registers after each has taken in its own stretch of bytes; byte by byte, all stretches at once."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, out = starts[order], sizes[order], register[order]
    longest = int(sizes[0]) if len(sizes) else 0
    # How many stretches have a byte number k.
    reach = len(sizes) - np.searchsorted(sizes[::-1], np.arange(min(longest, LONG_WORD)), "right")
    for k, m in enumerate(reach.tolist()):
        now = out[:m]
        out[:m] = STEPS[(now ^ data[starts[:m] + k]) & 255] ^ (now >> 8)
    for i in range(int(np.searchsorted(-sizes, -LONG_WORD))):
        rest = data[starts[i] + LONG_WORD : starts[i] + sizes[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, buckets of the words, buckets of the pairs, pairs' first words, and row bounds in words."""
    for w in words(texts, LETTERS_AND_DIGITS):
        n = len(w.starts)
        sizes = w.ends - w.starts
        one = _feed(np.full(n, 0xFFFFFFFF, np.uint32), w.data, w.starts, sizes)
        of = w.of
        first = np.flatnonzero(of[1:] == of[:-1])
        spaced = STEPS[(one[first] ^ np.uint32(0x20)) & 255] ^ (one[first] >> 8)
        two = _feed(spaced, w.data, w.starts[first + 1], sizes[first + 1])
        full = np.int64(0xFFFFFFFF)
        yield w.row, (one ^ full) % buckets, (two ^ full) % buckets, first, w.bounds


def bucket_counts(df: DataFrame, text_column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket. Each task sends its sums once: ``buckets`` rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, one, two, _, _ in features(batch.column(0), buckets):
                sums += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(sums[used], pa.int64())})

    ready(df.sparkSession)
    texts = df.select(F.col(f"`{text_column}`").alias("text")).where(F.length("text") > 0)
    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier each bucket is in the target, floored; every count is one higher."""
    k = len(raw)
    s_all, t_all = float(int(raw.sum()) + k), float(int(target.sum()) + k)
    pairs = zip(raw.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in pairs], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_words, n_features, weight`` of each row: the floored mean gain of its features (none: 0)."""
    sent = df.sparkSession.sparkContext.broadcast(gain)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n_words, n_features, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for row, one, two, first, bounds in features(batch.column(1), len(sent.value)):
                own = sent.value[one]
                own[first] += sent.value[two]
                sums = np.concatenate([[0], np.cumsum(own)])
                n = np.diff(bounds)
                here = slice(row, row + len(n))
                n_words[here], n_features[here] = n, n + np.maximum(n - 1, 0)
                total[here] = sums[bounds[1:]] - sums[bounds[:-1]]
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            made = {"n_words": n_words, "n_features": n_features, "weight": weight}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, pa.int64()) for v in made.values())], names=["id", *made]
            )

    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(row_id: Column, seed: int) -> Column:
    """1000 times a Gumbel number that the id decides, floored; a NULL id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def kth_key(rows: DataFrame, keys: list[str], k: int, pivots: int = PIVOTS, few: int = FEW_ROWS) -> Row:
    """The ``k``-th smallest (from 1) of the composite ``keys``, which are not NULL and differ from row to row.

    Quickselect over all rows: the keys of some random rows of the open interval are pivots; one aggregate counts
    exactly the rows below and at each; the interval that holds the k-th goes on. The pivots are drawn by a
    hash of the key and the round, so a repeated task draws the same ones. Once ``few`` rows are left they are sorted.
    """
    types = {f.name: f.dataType for f in rows.schema.fields}
    key = F.struct(*keys)

    def at(found: Row) -> Column:
        return F.struct(*(F.lit(found[c]).cast(types[c]).alias(c) for c in keys))

    inside, before, left, turn = rows, 0, rows.count(), 0
    while left > few:
        drawn = inside.select(*keys).orderBy(F.xxhash64(F.lit(turn), *keys), *keys).limit(pivots).collect()
        drawn.sort(key=tuple)
        sums = [F.count_if(key < at(p)).alias(f"below{i}") for i, p in enumerate(drawn)]
        counts = inside.agg(*sums).first()
        low, high = None, None
        for i, p in enumerate(drawn):
            rank = before + counts[f"below{i}"] + 1  # a pivot is one row
            if rank == k:
                return p
            if rank < k:
                low = (p, rank)
            elif high is None:
                high = (p, rank)
        last = high[1] - 1 if high else before + left
        if low:
            inside, before = inside.where(key > at(low[0])), low[1]
        if high:
            inside = inside.where(key < at(high[0]))
        left, turn = last - before, turn + 1
    return inside.select(*keys).orderBy(*keys).limit(k - before).collect()[-1]


def resample(
    docs: DataFrame, target: DataFrame, share_percent: int = SHARE_PERCENT, smallest_words: int = SMALLEST_WORDS,
    seed: int = SEED, buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text", few: int = FEW_ROWS,
) -> DataFrame:
    """``id_column, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is NULL for those not drawn.

    Features are the words and pairs of neighbouring words of the whole text, A-Z lowered; the CRC-32 of a feature gives
    its bucket. Bucket counts of all ``docs`` and all ``target`` texts become gains, and a row weighs the mean gain of
    its features. The score adds noise that the id decides; the highest scores of the rows with at least
    ``smallest_words`` words are drawn, ``share_percent`` of them rounded down, and ranked from 1.

    Equal scores go by the smaller id, NULL ids last. Rows that repeat an id and a score are told apart by
    the number of features and then by position, so exactly as many are drawn as asked. NULL and empty texts have no
    features and weight 0. Other columns of ``docs`` are left out, whatever their names. No documents: no rows; no
    target: all gains are those of a target without counts.

    Texts are read twice; what travels are a count per bucket and task, and the scores. The selection
    scans the scores a few times and moves counts only; of the rows just the drawn ones are sorted, by range.
    """
    ready(docs.sparkSession)
    gain = gains(bucket_counts(docs, text_column, buckets), bucket_counts(target, text_column, buckets))
    weighed = weigh(docs, gain, id_column, text_column).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    id_type = weighed.schema["id"].dataType
    scored = saved(
        weighed.select(
            "id", "n_words", "n_features", "weight", "score", (-F.col("score")).alias("k_score"),
            F.col("id").isNull().cast("int").alias("k_null"), F.coalesce("id", F.lit(0).cast(id_type)).alias("k_id"),
            F.monotonically_increasing_id().alias("k_row"),
        ),
        "resample-scores",
    )
    keys = ["k_score", "k_null", "k_id", "n_features", "k_row"]
    able = F.col("n_words") >= smallest_words
    wanted = scored.where(able).count() * share_percent // 100
    out = [F.col("id").alias(id_column), "n_features", "weight", "score"]
    if wanted == 0:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    last = kth_key(scored.where(able), keys, wanted, few=few)
    types = {f.name: f.dataType for f in scored.schema.fields}
    drawn = able & (F.struct(*keys) <= F.struct(*(F.lit(last[c]).cast(types[c]).alias(c) for c in keys)))
    winners = numbered(scored.where(drawn), [], keys, "rank").select(*out, "rank")
    return winners.unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("bigint").alias("rank")))
