import random

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Ünder", "eps", "zeta", "eta", "theta", "x1"]) for _ in range(n))


@pytest.fixture(scope="session")
def llm(spark):
    from rowmill.llm.table import ready

    return ready(spark)


@pytest.fixture(scope="session")
def awkward(llm):
    """Documents with NULL ids and texts, empty and very long texts, repeated rows, ties, and clashing column names."""
    rng = random.Random(5)
    base = "\n".join(sentence(rng, 12) for _ in range(6))
    texts = [
        base, base, base.replace("alpha", "other", 1), base.upper(), None, "", " ", "\n\n", "one", "one two", "one\ntwo\nthree",
        sentence(rng, 30_000), "Mail: a.b@c.de, ip 10.0.0.300 10.0.0.255; card 4111 1111 1111 1111 tel +49 (30) 1234567",
        "日本 語 " * 4, "tab\tand\x0bvertical\x0cfeed\r\nend", sentence(rng, 9), sentence(rng, 10),
        "same line\n" * 7, base + "\n" + sentence(rng, 3),
    ]
    rows = [(i, t, "en", "s", "shard?", 1) for i, t in enumerate(texts)]
    rows += [(0, base, "en", "s", None, None), (None, base, None, None, None, None), (None, None, None, None, None, None), (3, "other text of id 3", "de", "s", "x", 2)]
    return llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, Shard string, row bigint").repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


def kinds(rows):
    return sorted(rows, key=repr)
