import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rowmill.llm.table import KeyFilter
from rowmill.llm.words import BETWEEN_SPACES, LETTERS_AND_DIGITS, grams, words

from .conftest import LOWER

TEXT = st.text(alphabet="aAbZ09 \t\n\x0b.,-éß日\x00", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    for pattern, table in ((r"[^\x20\x09-\x0D]+", BETWEEN_SPACES), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LETTERS_AND_DIGITS)):
        want = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        got = []
        for w in words(pa.array(texts, pa.string()), table):
            got += [w.text(int(a), int(b)).split(" ") if b > a else [] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
        assert got == want


def test_equal_words_have_equal_hashes_wherever_they_stand():
    long = "y" * 500
    texts = ["a bb ccc", f"ccc {long} bb", f"x{long}", "x " + long]
    seen = {}
    for w in words(pa.array(texts * 2000), BETWEEN_SPACES):
        for r in range(w.rows):
            for i in range(w.bounds[r], w.bounds[r + 1]):
                word, h = w.text(i, i + 1), int(w.hashes()[i]) if w.rows < 4 else None
                if h is not None:
                    assert seen.setdefault(word, h) == h
    one = next(words(pa.array(["bb"]), BETWEEN_SPACES)).hashes()[0]
    assert one == next(words(pa.array(["a bb"]), BETWEEN_SPACES)).hashes()[1]


def test_grams_depend_on_order_and_length():
    h = np.arange(1, 7, dtype=np.uint64)
    assert len(grams(h, 3)) == 4 and len(grams(h, 7)) == 0
    assert grams(h[:2], 2)[0] != grams(h[:2][::-1], 2)[0]
    assert grams(h, 3)[1] == grams(h[1:4], 3)[0]


def test_key_filter_has_no_false_negatives(llm):
    from pyspark.sql import functions as F

    keys = llm.range(5000).select(F.xxhash64("id").alias("k"))
    may = KeyFilter.of(keys, "k", 5000)
    values = keys.toArrow().column("k").to_numpy().view(np.uint64)
    assert may(values).all()
    others = llm.range(10_000, 20_000).select(F.xxhash64("id").alias("k")).toArrow().column("k").to_numpy().view(np.uint64)
    assert may(others).mean() < 0.2
    assert not KeyFilter.of(keys.where("false"), "k", 0)(others).any()
