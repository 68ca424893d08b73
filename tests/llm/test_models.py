"""Pieces, scores, near duplicates, code search and the pipeline."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowmill.llm import codes, mixing, neardup, sentencepiece
from rowmill.llm.components import components
from rowmill.llm.words import raw_bytes

from .conftest import LOWER

needs_model = pytest.mark.skipif(not os.path.exists(sentencepiece.DEFAULT_MODEL), reason="no vocabulary file")

# ---- pieces


def small_vocabulary():
    pieces = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "a", "b", "▁a", "ab", "ba", "aba", "▁ab", "▁▁", "b\nb"]
    scores = [0.0] * 256 + [-3.0, -2.0, -2.5, -4.0, -3.9, -4.5, -5.0, -5.5, -5.0, -1.0]
    return sentencepiece.Vocabulary(tuple(pieces), tuple(scores), tuple(i >= 256 for i in range(len(pieces))), tuple(range(256)), "small")


def best_score(v, text):
    table = {p: s for p, s, ok in zip(v.pieces, v.scores, v.normal, strict=True) if ok}
    unknown = min(table.values()) - sentencepiece.UNKNOWN_PENALTY
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            if text[start:end] in table:
                best[end] = max(best[end], best[start] + table[text[start:end]])
        if text[end - 1] not in table:
            best[end] = max(best[end], best[end - 1] + unknown)
    return best[-1]


def total(v, ids, unknown_chars):
    unknown = min(s for s, ok in zip(v.scores, v.normal, strict=True) if ok) - sentencepiece.UNKNOWN_PENALTY
    return sum(v.scores[i] for i in ids if v.normal[i]) + unknown * unknown_chars


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c\né▁日", max_size=14))
def test_segmentation_is_best_and_restores(text):
    v = small_vocabulary()
    seg = sentencepiece.Segmenter(v)
    ids = seg.encode_all(pa.array([text])).to_pylist()[0]
    assert seg.decode_all(pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [text]
    if text and "▁" not in text:
        escaped = ("▁" + text.replace(" ", "▁"))
        unknown = sum(c not in v.pieces for c in escaped) if "\n" not in text else None
        if unknown is not None:
            assert math.isclose(total(v, ids, unknown), best_score(v, escaped))


@needs_model
def test_pieces_of_the_vocabulary(awkward, nothing):
    v = sentencepiece.Vocabulary.load()
    seg = sentencepiece.Segmenter(v)
    for text in ("Hello world", "the of then", "a  b   c", "Zürich!"):
        ids = seg.encode_all(pa.array([text])).to_pylist()[0]
        assert math.isclose(total(v, ids, 0), best_score(v, "▁" + text.replace(" ", "▁")), rel_tol=1e-9)
    out = sentencepiece.document_pieces(awkward, v)
    rows = out.collect()
    assert len(rows) == awkward.count() and all(r["restored"] for r in rows)
    assert all((r["pieces"] is None) == (r["n_pieces"] == 0 and r["pieces"] is None) for r in rows)
    kept = sentencepiece.encode(awkward.withColumn("Pieces", F.lit(1)), v)
    assert kept.columns == [*awkward.columns, "pieces"]
    assert sentencepiece.document_pieces(nothing, v).count() == 0


def test_bytes_that_are_no_text_are_replaced():
    seg = sentencepiece.Segmenter(small_vocabulary())
    assert seg.decode_all(pa.array([[0xC3], None, []], pa.list_(pa.int32()))).to_pylist() == ["\ufffd", None, ""]


# ---- scores


def test_base_scores_and_probabilities(awkward, nothing, monkeypatch):
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    learns = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)), None]
    c = Counter(w for i, t in rows if learns(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        ((i, not learns(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows),
        key=repr,
    )
    for frequent in (mixing.FREQUENT, 4):
        monkeypatch.setattr(mixing, "FREQUENT", frequent)
        got = mixing.document_scores(awkward).collect()
        assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in got), key=repr) == want
        assert all(r["score"] < 0 for r in got)
    assert mixing.document_scores(nothing).count() == 0
    held = mixing.document_scores(awkward.where("doc_id = 12 OR doc_id = 0").where(mixing.held_out(F.col("doc_id")) | F.lit(True)))
    assert held.count() == awkward.where("doc_id = 12 OR doc_id = 0").count()


def test_probabilities_of_all_texts_of_a_length_add_up():
    """The model codes bytes and the end, so texts of up to n bytes have a total probability below 1, near it for one symbol."""
    data, offsets = raw_bytes(pa.array(["ab", "ba", "aab", ""]))
    pairs = np.bincount(mixing.stream(data, offsets).symbols, minlength=256 * 257)
    code = mixing.code_of(pairs)
    counts = [np.zeros(2 << b, np.int64) for _, b in mixing.ORDERS]
    mixing.count_bits(data, offsets, code, counts)
    model = mixing.model_of(code, counts)
    empty = 2.0 ** -mixing.bits_of(model, *raw_bytes(pa.array([""])))[0]
    kraft = sum(2.0 ** -float(s) for s in code.size[:257])
    assert math.isclose(kraft, 1.0) and 0 < empty < 1
    first = sum(2.0 ** -x for x in mixing.bits_of(model, *_raw([bytes([b]) for b in range(256)])))
    assert empty + first <= 1 + 1e-6


def _raw(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def test_the_model_learns_and_adapts():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "quick", "brown", "fox"]) for _ in range(200)) for _ in range(30)]
    data, offsets = raw_bytes(pa.array(texts[:20]))
    code = mixing.code_of(np.bincount(mixing.stream(data, offsets).symbols, minlength=256 * 257))
    counts = [np.zeros(2 << b, np.int64) for _, b in mixing.ORDERS]
    mixing.count_bits(data, offsets, code, counts)
    model = mixing.model_of(code, counts)
    own, other = raw_bytes(pa.array(texts[20:])), raw_bytes(pa.array(["".join(chr(97 + rng.randrange(26)) for _ in range(900))]))
    assert mixing.bits_of(model, *own).sum() / len(own[0]) < 0.8 < 4 < mixing.bits_of(model, *other).sum() / len(other[0])
    # Each text is scored by itself, whatever stands beside it.
    alone = [mixing.bits_of(model, *raw_bytes(pa.array([t])))[0] for t in texts[20:]]
    assert np.allclose(alone, mixing.bits_of(model, *own))


# ---- near duplicates


def groups(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(n) and rows[m][0] is not None]
        comp = (min(ids, default=None) if sets[n] else i)
        out.append((i, len(sets[n]), comp, i == comp))
    return sorted(out, key=repr)


def test_groups_of_awkward_rows(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = sorted((tuple(r) for r in neardup.document_groups(awkward).collect()), key=repr)
    assert got == groups(rows)
    assert neardup.document_groups(nothing).count() == 0
    kept = neardup.one_of_each(awkward)
    # Rows that repeat an id and a text are one document.
    pairs = {(i, t) for i, t in rows if next(g[3] for g in groups([*rows, (i, t)]) if g[0] == i)}
    assert kept.columns == awkward.columns and kept.count() == kept.select("doc_id", "text").distinct().count()
    assert {(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()} <= pairs and kept.count() == sum(g[3] for g in got) - 1


def test_a_ball_of_near_copies_keeps_every_link(llm):
    """Copies of one text with few to many changes: most pairs are near the threshold, and one leader cannot link all."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(i, text) for i, (_, text) in enumerate(rows[:40])]
    got = sorted((tuple(r) for r in neardup.document_groups(llm.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == groups(rows)


def test_components_of_chains_and_stars(llm):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(1, 2), (2, 1), (3, 3)]
    got = {r["node"]: r["comp"] for r in components(llm.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(200, 260)} == {7} == {got[7]}
    assert got[2] == got[1] == 1 and 3 not in got


def test_sketches_estimate(llm):
    rng = np.random.default_rng(3)
    for share in (0.6, 0.75, 0.9):
        common = int(1000 * share)
        off = []
        for _ in range(40):
            s = rng.integers(0, 1 << 63, 2000 - common, np.uint64)
            rest = (1000 - common)
            a, b = np.unique(s[: common + rest]), np.unique(np.concatenate([s[:common], s[common + rest :]]))
            x = neardup.odd_sketch(neardup.minima(a)) ^ neardup.odd_sketch(neardup.minima(b))
            off.append(sum(int(v).bit_count() if v >= 0 else int(v & 0xFFFFFFFFFFFFFFFF).bit_count() for v in x.tolist()))
        jaccard = common / (2000 - common)
        want = 128 * (1 - (1 - 1 / 128) ** (2 * neardup.SAMPLES * (1 - jaccard)))
        assert abs(np.mean(off) - want) < 6


# ---- code search


def brute_nearest(rows, queries, k, bits):
    code = lambda v: [x is not None and x > 0 for x in v]
    good = [(i, code(v)) for i, v in rows if i is not None and v is not None and len(v) == bits]
    out = []
    for q, c in sorted({(i, tuple(code(v))) for i, v in queries if i is not None and v is not None and len(v) == bits}):
        near = sorted((sum(a != b for a, b in zip(c, d, strict=True)), i) for i, d in good)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("n", "bits", "k"), [(300, 24, 5), (7, 16, 10), (400, 9, 3)])
def test_nearest_codes(llm, n, bits, k):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1.0, 1.0]) for _ in range(bits)]) for i in range(n)]
    rows += [(n + i, list(rows[0][1])) for i in range(n // 3)] + [(None, rows[0][1]), (10_000, None), (10_001, [1.0]), (10_002, [0.0] * bits), (10_003, [float("nan")] * bits), (5, rows[5][1])]
    df = llm.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    got = codes.nearest(df, df.where("vec_id % 20 = 0"), k, bits)
    assert sorted(map(tuple, got.collect())) == brute_nearest(rows, queries, k, bits)
    assert codes.nearest(df.where("false"), df, k, bits).count() == 0
    assert codes.nearest(df, df.where("false"), k, bits).count() == 0
