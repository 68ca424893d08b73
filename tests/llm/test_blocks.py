"""Large buckets of near duplicates, dealt into blocks."""

import random

from rowmill.llm import neardup

from .test_models import groups


def test_small_blocks_keep_every_link(llm, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 7)
    rng, rows = random.Random(13), []
    for ball in range(2):
        base = [f"w{ball}_{i}" for i in range(110)]
        for i in range(110):
            words = list(base)
            for _ in range(rng.choice([1, 2, 4, 5, 6, 8, 9])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((ball * 1000 + i, " ".join(words)))
    joins = []
    real = neardup._possible
    monkeypatch.setattr(neardup, "_possible", lambda a, b: joins.append(1) or real(a, b))
    got = sorted((tuple(r) for r in neardup.document_groups(llm.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == groups(rows)
    # The case is one in which leaders do not suffice, so that blocks were met.
    assert joins
