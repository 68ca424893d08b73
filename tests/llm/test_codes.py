"""Code search with ids of other types, and segments as wide as the rows ask for."""

import random

from rowmill.llm import codes


def test_ids_are_of_any_type(llm):
    rng = random.Random(4)
    rows = [(f"v{i:03d}", [rng.uniform(-1, 1) for _ in range(32)]) for i in range(120)]
    rows += [("v007", rows[7][1]), ("copy", rows[7][1]), (None, rows[1][1]), ("null", None), ("short", [1.0])]
    df = llm.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = codes.nearest(df, df.where("vec_id IN ('v007', 'v011', 'null')"), 5, 32).collect()

    def code(v):
        return tuple(x > 0 for x in v)

    want = []
    for q in ("v007", "v011"):
        own = code(next(v for i, v in rows if i == q))
        near = sorted((sum(a != b for a, b in zip(own, code(v), strict=True)), i) for i, v in rows if i and v and len(v) == 32)
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_segments_widen_with_the_rows():
    widest = [max(codes._widths(128, n)) for n in (0, 1000, 10**6, 10**8, 10**9, 10**13)]
    assert widest == sorted(widest) and widest[0] == 4 and widest[3] > 20 and widest[-1] <= codes.WIDEST_SEGMENT
    assert all(sum(codes._widths(bits, 10**9)) == bits for bits in (7, 31, 128, 300))
