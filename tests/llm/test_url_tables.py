"""Url rules by join against the trie and brute force, and more rules than a trie may have."""

import random

import pytest

from rowmill.llm import urls

from .test_filters import RULES, URLS, brute


@pytest.mark.parametrize("frequent", [1, 3, 4096])
def test_joined_rules_fit_like_the_trie(llm, frequent):
    rng = random.Random(frequent)
    labels = ["com", "org", "a", "b", "example", ""]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    paths = ["".join(rng.choice(["/", "x", "y", "/en", "1"]) for _ in range(rng.randrange(0, 5))) for _ in range(40)]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(120)]
    rows = [f"http://{rng.choice(hosts)}/{rng.choice(paths)}?q" for _ in range(300)] + ["http://www.example.org/en/1"] * 200 + [None, "no url", "://", *URLS]
    df = llm.createDataFrame([(i, u, "taken", 1) for i, u in enumerate(rows)], "page_id int, url string, Host string, url_row int").repartition(3)
    table = llm.createDataFrame(rules, "verdict string, host string, path string")
    by_join = urls._joined(df, table.unionByName(table.limit(5)), "url", "allow", frequent)
    by_trie = urls.judge(df, rules)
    assert by_join.columns == by_trie.columns
    assert sorted((tuple(r) for r in by_join.collect()), key=repr) == sorted((tuple(r) for r in by_trie.collect()), key=repr)


def test_tables_and_nulls(llm):
    df = llm.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id int, url string")
    table = llm.createDataFrame([*RULES, (None, "org", "/"), ("block", None, "/"), ("block", "com", None)], "verdict string, host string, path string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, table).collect()}
    assert got == {u: brute(u, RULES) for u in URLS}
    assert urls.judge(df.where("false"), table).count() == 0
    assert {r["verdict"] for r in urls.judge(df, table.where("false"), default="block").collect()} == {"block"}


def test_more_rules_than_a_trie_takes(llm, monkeypatch):
    monkeypatch.setattr(urls, "MOST_RULES", 3)
    df = llm.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id int, url string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, RULES).collect()}
    assert got == {u: brute(u, RULES) for u in URLS}
