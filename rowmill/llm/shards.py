"""Shards of near-equal bytes by sampled, size-weighted splitters."""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.table import fresh, replace, saved

# Ranges per shard: a shard ends at a range, so its bytes are within a range of the ideal.
RANGES_PER_SHARD = 128
# Sampled keys per range; all rows are sampled when there are fewer.
SAMPLES_PER_RANGE = 8
# A range above this many times its fair size is split again.
OVERFULL = 2
# Rounds of splitting at most. Each cuts an overfull range to about its fair size, unless one row is larger than that.
ROUNDS = 6

Key = tuple[int, int, int]


def _sample(keys: DataFrame, rate: Column, seed: int) -> list[Key]:
    """Keys drawn with a chance of ``size * rate``, in order; by a hash of the key, so a repeated task draws the same."""
    chance = F.pmod(F.xxhash64(F.lit(seed), "k1", "k2", "k3"), F.lit(1 << 40)) / float(1 << 40)
    picked = keys.where(chance < F.col("size") * rate).select("k1", "k2", "k3")
    return sorted((r["k1"], r["k2"], r["k3"]) for r in picked.toLocalIterator())


def _quantiles(sample: Sequence[Key], parts: int) -> list[Key]:
    """The keys that cut a sorted sample into so many parts of equal number."""
    return sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []


def _range_of(key: Sequence[Column], splitters: Sequence[Key]) -> Column:
    """How many splitters are at or below the key: a binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    bounds = F.from_json(
        F.lit(json.dumps([{"a": a, "b": b, "c": c} for a, b, c in splitters])), "array<struct<a:bigint,b:bigint,c:bigint>>"
    )
    n = len(splitters)
    own = F.struct(*(c.alias(x) for c, x in zip(key, "abc", strict=True)))

    def step(acc: Column, _: Column) -> Column:
        low, high = acc["low"], acc["high"]
        mid = F.floor((low + high) / 2).cast("int")
        below = F.get(bounds, mid) <= own
        open_ = low < high
        return F.struct(
            F.when(open_ & below, mid + 1).otherwise(low).alias("low"),
            F.when(open_ & ~below, mid).otherwise(high).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, step, lambda acc: acc["low"])


def _facts(keys: DataFrame, splitters: Sequence[Key]) -> dict[int, tuple[int, int]]:
    """Exact bytes and rows of each range that has rows; at most a row per range comes back."""
    place = _range_of([F.col("k1"), F.col("k2"), F.col("k3")], splitters).alias("r")
    found = keys.groupBy(place).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).orderBy("r").collect()
    return {r["r"]: (r["bytes"], r["rows"]) for r in found}


def _ranges(keys: DataFrame, ranges: int) -> tuple[list[Key], dict[int, tuple[int, int]]]:
    """Splitters of ranges of near-equal bytes, and the exact bytes and rows of the ranges.

    The first splitters are quantiles of a size-weighted sample. A range whose exact size proves overfull is sampled
    again, as densely as its size asks for, and split at the quantiles found inside it. All samples together are
    bounded by the number of ranges.
    """
    total = keys.agg(F.sum("size").alias("b")).first()["b"] or 0
    fair = max(1, total / ranges)
    splitters = _quantiles(_sample(keys, F.lit(SAMPLES_PER_RANGE / fair), 7), ranges)
    facts = _facts(keys, splitters)
    for turn in range(ROUNDS):
        # One row alone cannot be split.
        over = {r for r, (size, rows) in facts.items() if size > OVERFULL * fair and rows > 1}
        if not over:
            break
        place = _range_of([F.col("k1"), F.col("k2"), F.col("k3")], splitters)
        inside = keys.where(place.isin(sorted(over)))
        more: dict[int, list[Key]] = {}
        for key in _sample(inside, F.lit(SAMPLES_PER_RANGE / fair), 8 + turn):
            more.setdefault(bisect_right(splitters, key), []).append(key)
        added = {q for r, sample in more.items() for q in _quantiles(sample, max(2, math.ceil(facts[r][0] / fair)))}
        if added <= set(splitters):
            break
        splitters = sorted(added | set(splitters))
        facts = _facts(keys, splitters)
    return splitters, facts


def assign(df: DataFrame, size: Column, group: Column, row_id: Column, shards: int) -> DataFrame:
    """Add ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in its shard) to every row.

    Rows are ordered by (``group``, ``row_id``), both bigint, rows equal in both by a number that they get when they
    are written to the shared folder first, so that no key is hot: a record that is repeated is subdivided
    like any other. Keys are sampled with a chance in proportion to ``size``; sample quantiles are the splitters
    of many small ranges. Exact bytes tell overfull ranges, which are sampled and split again. Exact bytes and rows
    of the ranges then place each range in a shard, the cumulative middle deciding, and a row's slot is the
    rows of the ranges before it in its shard plus its place in its range. No task sorts a group larger than a range: about
    1 / (shards * RANGES_PER_SHARD) of the bytes, or one row.

    NULL sizes count as 0, NULL keys as the smallest key. No rows: no output rows. Columns called ``shard`` or ``slot``
    are replaced; any other column is kept.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    k1, k2, k3, size_name, place = fresh(df, "k1", "k2", "k3", "size", "range")
    low = F.lit(-(1 << 63))
    keyed = saved(
        df.select(
            *(F.col(f"`{c}`") for c in df.columns),
            F.coalesce(group.cast("bigint"), low).alias(k1),
            F.coalesce(row_id.cast("bigint"), low).alias(k2),
            F.monotonically_increasing_id().alias(k3),
            F.coalesce(size.cast("bigint"), F.lit(0)).alias(size_name),
        ),
        "shard-rows",
    )
    names = ((k1, "k1"), (k2, "k2"), (k3, "k3"), (size_name, "size"))
    keys = keyed.select(*(F.col(c).alias(n) for c, n in names))
    splitters, facts = _ranges(keys, shards * RANGES_PER_SHARD)
    total = sum(size for size, _ in facts.values()) or 1
    shard_of, base, filled, done = {}, {}, [0] * shards, 0
    for r in sorted(facts):
        bytes_, rows = facts[r]
        shard = min(shards - 1, (2 * done + bytes_) * shards // (2 * total))
        shard_of[r], base[r] = shard, filled[shard]
        filled[shard] += rows
        done += bytes_
    known = json.dumps([{"s": shard_of.get(i, 0), "b": base.get(i, 0)} for i in range(len(splitters) + 1)])
    table = F.from_json(F.lit(known), "array<struct<s:int,b:bigint>>")
    ranged = keyed.withColumn(place, _range_of([F.col(k1), F.col(k2), F.col(k3)], splitters))
    in_range = Window.partitionBy(place).orderBy(k1, k2, k3)
    own = F.get(table, F.col(place))
    numbered = ranged.withColumn(fresh(ranged, "no")[0], F.row_number().over(in_range) - 1)
    out = replace(numbered, {"shard": own["s"], "slot": own["b"] + F.col(numbered.columns[-1])})
    return out.drop(k1, k2, k3, size_name, place, numbered.columns[-1])


def document_shards(documents: DataFrame, shards: int = 24) -> DataFrame:
    """The layout of documents: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``bytes``: shards hold nearly the same bytes. Size is the text's bytes plus 8 (NULL text:
    8, checksum of the empty text). Equal texts lie next to each other, since the order is that of the
    checksum.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    out = assign(rows, F.col("size"), F.col("text_crc32"), F.col("doc_id"), shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, assigned_path: str) -> None:
    """Write assigned rows as one folder per shard, rows in slot order inside each file.

    Files of a shard are cut at 1,000,000 rows, so that no task writes a shard of unbounded size.
    """
    part = F.floor(F.col("slot") / 1_000_000)
    (
        df.repartition("shard", part)
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(assigned_path)
    )
