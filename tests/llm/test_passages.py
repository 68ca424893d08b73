"""Repeated passages of sentences against plain Python, however lines lie."""

import os
import random
import re
from collections import Counter

import pytest

from rowmill.llm import lines, stages

from .conftest import sentence

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def pieces_of(text):
    out, last = [], 0
    for m in re.finditer(r"(?<=[.!?][ \t\n\x0b\f\r])(?=[^ \t\n\x0b\f\r])|(?<=\n)(?=[^ \t\n\x0b\f\r])", text):
        if m.start() > last or m.start() == 0 < len(text) and last < m.start():
            out.append(text[last : m.start()])
            last = m.start()
    return [*out, text[last:]]


def without_passages(rows, words=50):
    """(id, text, pieces removed): every later window gone, in the order of (id, position)."""
    found, per_row = {}, []
    for i, text in rows:
        pieces = pieces_of(text) if i is not None and text else []
        counts = [len([w for w in re.split(r"[ \t\n\x0b\f\r]+", p) if w]) for p in pieces]
        windows = []
        for start in range(len(pieces)):
            total = 0
            for end in range(start, len(pieces)):
                total += counts[end]
                if total >= words:
                    key = tuple(p.replace("\n", " ").rstrip(" ") for p in pieces[start : end + 1])
                    windows.append((start, end + 1, key))
                    found[key] = min(found.get(key, (i, start)), (i, start))
                    break
        per_row.append((pieces, windows))
    out = []
    for (i, text), (pieces, windows) in zip(rows, per_row, strict=True):
        gone = {k for start, end, key in windows if (i, start) > found[key] for k in range(start, end)}
        out.append((i, "".join(p for k, p in enumerate(pieces) if k not in gone) if gone else text, len(gone)))
    return out


def run(df, **options):
    out = lines.drop_passages(df, **options)
    return sorted(((r["doc_id"], r["text"], r["pieces_removed"]) for r in out.collect()), key=repr)


def prose(rng, sentences):
    return [sentence(rng, rng.randrange(5, 25)).capitalize() + rng.choice([".", "!", "?"]) for _ in range(sentences)]


@pytest.mark.parametrize("frequent", [1, 4096])
def test_against_plain_python(llm, frequent):
    rng = random.Random(frequent)
    shared = [prose(rng, 6) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = prose(rng, rng.randrange(0, 4)) + (rng.choice(shared) if rng.random() < 0.6 else []) + prose(rng, rng.randrange(0, 4))
        rows.append((i, "".join(p + rng.choice([" ", "\n", "  ", "\n\n"]) for p in parts)))
    rows += [(i, " ".join(shared[0])) for i in range(100, 160)] + [(None, " ".join(shared[0])), (200, None), (201, ""), (202, " \n"), (1, " ".join(shared[1]))]
    df = llm.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, Pieces int, pieces_removed string").repartition(3)
    assert run(df, frequent=frequent) == sorted(without_passages(rows), key=repr)
    assert lines.drop_passages(df).columns == ["doc_id", "text", "Pieces", "pieces_removed"]
    assert lines.drop_passages(df.where("false")).count() == 0


def test_awkward_rows(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert run(awkward) == sorted(without_passages(rows), key=repr)


def test_a_passage_in_other_lines_is_cut(llm):
    """The same sixty words as one line of a text and as part of another one's line."""
    rng = random.Random(8)
    passage = " ".join(prose(rng, 5))
    while len(passage.split()) <= 55:
        passage += " " + " ".join(prose(rng, 1))
    first, second = f"Own words here.\n{passage}\nEnd.", f"Something else before it. {passage} And after it"
    df = llm.createDataFrame([(1, first, 1), (2, second, 2)], "doc_id bigint, text string, n_chars bigint")
    got = {r["doc_id"]: r["text"] for r in stages.line_dedup(llm, df, "").collect()}
    assert got[1] == first and len(got[2].split()) < len(second.split()) - 40 and got[2].startswith("Something else before it.")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_long_lines_that_repeat_do_not_stay(llm):
    """Whole lines of over fifty words: after the stage each is there once."""
    docs = llm.read.parquet(f"{FOLDER}/documents.parquet")
    out = stages.line_dedup(llm, docs, FOLDER)
    seen = Counter(line for r in out.select("text").collect() for line in (r["text"] or "").split("\n") if len(line.split()) > 50)
    assert seen and max(seen.values()) == 1


def test_stages_keep_columns_of_their_own_names(llm):
    """Columns called like those that the stages add are kept by all but the last, which replaces its own."""
    df = llm.createDataFrame([(1, "one two three", 7, "x", 9, True), (2, "", 8, "y", 9, False)],
                             "doc_id bigint, text string, Lines_Removed int, pieces_removed string, n_pieces int, restored boolean")
    cut = stages.line_dedup(llm, df, "")
    assert cut.columns == df.columns and sorted(cut.collect()) == sorted(df.collect())
    out = stages.sentencepiece_pieces(llm, df, "")
    assert len(set(c.lower() for c in out.columns)) == len(out.columns) and out.where("restored").count() == 2
