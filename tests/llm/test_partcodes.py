"""Codes of vector parts against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from rowmill.llm import partcodes


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract, step by step."""
    kept = [(i, l, v) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(parts, -(-max(len(v) for _, _, v in kept) // parts) * parts)
    size = width // parts
    ints = [[math.floor(4096 * x) for x in v] + [0] * (width - len(v)) for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][2]))[:entries]
    cut = [[v[j * size : (j + 1) * size] for j in range(parts)] for v in ints]
    books = [[cut[r][j] for r in order] for j in range(parts)]

    def assign():
        out = []
        for v in cut:
            out.append([min((sum((a - b) ** 2 for a, b in zip(v[j], e, strict=True)), k) for k, e in enumerate(books[j])) for j in range(parts)])
        return out

    for _ in range(rounds):
        got = assign()
        for j in range(parts):
            for k in range(len(books[j])):
                mine = [cut[r][j] for r in range(len(cut)) if got[r][j][1] == k]
                if mine:
                    books[j][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    got = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in g) for g in got]
    sums = {}
    for (_, label, _), e in zip(kept, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in g), e, sums[label], digest) for (i, label, _), g, e in zip(kept, got, errors, strict=True)), key=repr
    )


def run(llm, rows, **options):
    full = [(*r, "x", 1, 2.0) for r in rows]
    df = llm.createDataFrame(full, "vec_id bigint, embedding array<float>, label int, code string, vector int, Error double").repartition(3)
    out = partcodes.compress(df, **options)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def vectors(n, dim, seed, grain=64):
    rng = random.Random(seed)
    return [(i * 7 % n, [rng.randrange(-grain, grain) / grain for _ in range(dim)], rng.choice([None, 1, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("dim", [8, 32, 27, 3])
def test_against_plain_python(llm, dim):
    rows = vectors(120, dim, dim)
    assert run(llm, rows) == plain(rows)


def test_awkward_rows(llm):
    good = vectors(40, 16, 3, grain=2)  # many ties
    rows = good + good[:15] + [
        (None, good[0][1], None), (None, None, 1), (3, None, None), (4, [None] * 16, 1), (5, [1.0] * 15 + [float("nan")], 1),
        (6, [float("inf")] * 16, 2), (-1, [], 2), (-2, [0.5], 2), (200, [100.0] * 16, None),
    ]
    assert run(llm, rows) == plain(rows)
    assert run(llm, rows, frequent=1) == plain(rows)
    assert run(llm, rows[-8:-3]) == []
    assert run(llm, good[:1]) == plain(good[:1]) and run(llm, good[:5]) == plain(good[:5])
    assert run(llm, []) == []


def test_huge_components_do_not_overflow(llm):
    out = run(llm, [(i, [3.0e38 * (-1) ** i] * 8, 1) for i in range(20)])
    assert len(out) == 20 and all(r[2] >= 0 for r in out)


def test_bounds_rule_out_distances_and_lose_nothing():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 64)) * 3000
    rows = (centres[rng.integers(0, 16, 3000)] + rng.normal(size=(3000, 64)) * 150).astype(np.int64)
    books = partcodes.Codebooks.start(centres.astype(np.int64))
    codes, errors, evaluated = books.nearest(rows, books.to_pivots(rows))
    all_ = partcodes.squared(rows.reshape(3000, 8, 1, 8), books.entries[None])
    assert (codes == all_.argmin(axis=2)).all() and (errors == all_.min(axis=2)).all()
    assert evaluated < 0.35 * all_.size
