"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rowmill.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bucket(feature, buckets=10_000):
    return zlib.crc32(feature.encode()) % buckets


def plain(docs, target, share=25, smallest=20, buckets=10_000):
    """The contract, step by step."""
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d for _, d in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f, buckets)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        words, fs = features(text)
        weight = sum(gain[bucket(f, buckets)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= smallest), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for n, r in enumerate(able[: share * len(able) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def run(docs, target, **options):
    out = resample.resample(docs, target, **options)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.fixture(scope="module")
def target(llm):
    texts = ["alpha beta gamma alpha", "Zeta ETA eta theta x1 x1", None, "", "Ünder, eps"]
    return llm.createDataFrame([(t, 1) for t in texts], "text string, rank int"), texts


@pytest.mark.parametrize("few", [1, 3, 4096])
def test_awkward_rows(awkward, nothing, target, few):
    df, texts = target
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert run(awkward, df, few=few) == plain(rows, texts)
    assert run(nothing, df) == []
    assert run(awkward, df.where("false"), share_percent=100, smallest_words=0, few=few) == plain(rows, [], share=100, smallest=0)
    assert run(awkward, df, share_percent=0) == plain(rows, texts, share=0)


def test_copies_of_one_row(llm, target):
    """A third of all rows is one row: exactly as many as asked are drawn."""
    df, texts = target
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Zeta", "other"]) for _ in range(rng.randrange(15, 60)))) for i in range(100)]
    rows += [(500, "alpha beta gamma " * 9)] * 60
    docs = llm.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, rank int, K_ROW int").repartition(4)
    for share in (3, 25, 40, 90):
        assert run(docs, df, share_percent=share, few=2) == plain(rows, texts, share=share)


def test_kth_key_at_every_place(llm):
    rng = random.Random(4)
    values = [(rng.randrange(5), i) for i in range(60)]
    df = llm.createDataFrame(values, "a int, b int").repartition(3)
    for k in range(1, 61, 7):
        assert tuple(resample.kth_key(df, ["a", "b"], k, pivots=3, few=1)) == sorted(values)[k - 1]


def test_checksums_of_words():
    text = ["short and " + "l" * 63 + " " + "m" * 64 + " " + "n" * 65 + " " + "ö" * 500 + " end", None, "", "x", "日本 語"]
    for row, one, two, first, bounds in resample.features(pa.array(text), 1 << 32):
        for r in range(len(bounds) - 1):
            words, fs = features(text[row + r])
            inner = (first >= bounds[r]) & (first < bounds[r + 1])
            got = [*one[bounds[r] : bounds[r + 1]], *two[inner]]
            assert got == [zlib.crc32(f.encode()) for f in fs]


def test_gains_are_floored():
    raw, goal = np.array([3, 0, 10]), np.array([0, 2, 1])
    want = [math.floor(1000 * math.log((b + 1) * 16 / ((a + 1) * 6))) for a, b in zip(raw, goal, strict=True)]
    assert resample.gains(raw, goal).tolist() == want
