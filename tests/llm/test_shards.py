"""Shards recomputed in plain Python, and keys that a third of all rows share."""

import math
import random
import struct
import zlib
from bisect import bisect_right
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from rowmill.llm import shards


def digest(seed, key):
    """The engine's hash of (int, long, long, long), field by field."""
    h = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
    for x in key:
        h = xxhash.xxh64(struct.pack("<q", x), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def plain(rows, count, per_shard):
    """The layout of (group, id, size) rows in the order of their numbers."""
    keys = [(-(1 << 63) if g is None else g, -(1 << 63) if i is None else i, n, s or 0) for n, (g, i, s) in enumerate(rows)]
    total, ranges = sum(k[3] for k in keys), count * per_shard
    fair = max(1, total / ranges)

    def sample(seed, some):
        return sorted(k[:3] for k in some if digest(seed, k[:3]) % (1 << 40) / float(1 << 40) < k[3] * (shards.SAMPLES_PER_RANGE / fair))

    def quantiles(drawn, parts):
        return sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)}) if drawn else []

    cuts, turn = quantiles(sample(7, keys), ranges), 0
    while turn < shards.ROUNDS:
        size, n = Counter(), Counter()
        for k in keys:
            size[bisect_right(cuts, k[:3])] += k[3]
            n[bisect_right(cuts, k[:3])] += 1
        over = {r for r in size if size[r] > shards.OVERFULL * fair and n[r] > 1}
        drawn = {}
        for key in sample(8 + turn, [k for k in keys if bisect_right(cuts, k[:3]) in over]):
            drawn.setdefault(bisect_right(cuts, key), []).append(key)
        added = {q for r, d in drawn.items() for q in quantiles(d, max(2, math.ceil(size[r] / fair)))}
        if not over or added <= set(cuts):
            break
        cuts, turn = sorted(added | set(cuts)), turn + 1
    members = {}
    for k in sorted(keys):
        members.setdefault(bisect_right(cuts, k[:3]), []).append(k)
    out, filled, done = {}, Counter(), 0
    for r in sorted(members):
        held = sum(k[3] for k in members[r])
        shard = min(count - 1, (2 * done + held) * count // (2 * total or 2))
        for k in members[r]:
            out[k[2]] = (shard, filled[shard])
            filled[shard] += 1
        done += held
    return [out[i] for i in range(len(rows))], max((sum(k[3] for k in m), len(m)) for m in members.values())


def layout(llm, rows, count):
    df = llm.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, g bigint, i bigint, s bigint").coalesce(1).sortWithinPartitions("n")
    out = shards.assign(df, F.col("s"), F.col("g"), F.col("i"), count)
    return [(r["shard"], r["slot"]) for r in sorted(out.collect(), key=lambda r: r["n"])]


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_python(llm, seed, monkeypatch):
    monkeypatch.setattr(shards, "RANGES_PER_SHARD", 16)
    rng = random.Random(seed)
    rows = [(rng.choice([None, 5, rng.randrange(1 << 32)]), rng.choice([None, rng.randrange(1000)]), rng.choice([None, 8, rng.randrange(4000)])) for _ in range(700)]
    rows += [(9, 9, 50)] * 300
    want, _ = plain(rows, 6, 16)
    assert layout(llm, rows, 6) == want
    assert layout(llm, rows[:3], 6) == plain(rows[:3], 6, 16)[0]


def test_a_repeated_record_is_subdivided(llm):
    """A third of all rows is one record: all shards hold nearly the same, and no range is large."""
    rows = [(zlib.crc32(b"%d" % i), i, 8 + i % 40) for i in range(4000)] + [(77, 7, 22)] * 2000
    got = layout(llm, rows, 24)
    held, slots = Counter(), {}
    for (shard, slot), (_, _, size) in zip(got, rows, strict=True):
        held[shard] += size
        slots.setdefault(shard, []).append(slot)
    mean = sum(held.values()) / 24
    assert len(held) == 24 and max(held.values()) < 1.03 * mean and min(held.values()) > 0.97 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert plain(rows, 24, shards.RANGES_PER_SHARD)[1][0] <= 4 * mean / shards.RANGES_PER_SHARD


def test_null_ids_and_equal_texts(llm):
    docs = llm.range(6000).select(F.lit(None).cast("bigint").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one text").otherwise(F.col("id").cast("string")).alias("text"))
    held = Counter()
    for r in shards.document_shards(docs, 24).collect():
        held[r["shard"]] += r["size"]
    mean = sum(held.values()) / 24
    assert len(held) == 24 and max(held.values()) < 1.03 * mean and min(held.values()) > 0.97 * mean
