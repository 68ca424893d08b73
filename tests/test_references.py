"""Foreign keys by value against all pairs, and what the sketches may and may not rule out."""

import random

import pytest

from rowmill.errors import IntakeError
from rowmill.functions.names import plural, singular
from rowmill.operators import browse, catalog, proposal, references, structure


def brute(tables):
    columns = {(t, c): [r[i] for r in rows if r[i] is not None] for t, (names, rows) in tables.items() for i, c in enumerate(names)}
    out = set()
    for c, child in columns.items():
        for p, parent in columns.items():
            if c[0] != p[0] and child and parent and type(child[0]) is type(parent[0]) and len(set(parent)) == len(parent) and set(child) <= set(parent):
                out.add((*c, *p, len(set(child)), len(set(parent))))
    return out


@pytest.mark.parametrize("size", [1, 4, 1024])
@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed, size):
    rng = random.Random(seed)
    pool = [rng.randrange(10**6) for _ in range(300)]
    texts = [f"k{v}" for v in pool]
    tables = {
        "a": (("x", "t"), [(v, s) for v, s in dict(zip(pool, texts, strict=True)).items()]),
        "b": (("y", "u"), [(rng.choice(pool), rng.choice(texts)) for _ in range(400)] + [(None, None)]),
        "c": (("z", "w"), [(rng.choice(pool) if rng.random() < 0.995 else -1, None) for _ in range(500)]),
        "d": (("n", "m"), [(i, f"k{i}") for i in range(5)]),
    }
    frames = {}
    for t, (names, rows) in tables.items():
        frames[t] = spark.createDataFrame(rows, f"{names[0]} int, {names[1]} string").repartition(3)
    found, stats = references.foreign_keys_by_value(frames, sketch_size=size)
    got = {tuple(r)[:6] for r in found.collect()}
    assert got == brute(tables)
    assert stats.pairs >= stats.by_count >= stats.by_sketch >= stats.confirmed == len(got)


def test_sketches_rule_out_most_pairs(spark):
    frames = {f"t{i}": spark.range(i * 10_000, i * 10_000 + 2_000).selectExpr(f"id AS c{i}") for i in range(6)}
    found, stats = references.foreign_keys_by_value(frames, sketch_size=64)
    assert (stats.pairs, stats.by_count, stats.by_sketch, found.count()) == (30, 30, 0, 0)


def test_best_parent_and_empty_sets(spark):
    frames = {
        "people": spark.range(10).selectExpr("id"), "visits": spark.range(9).selectExpr("id AS number", "id % 5 AS person_id"),
        "slots": spark.range(6).selectExpr("id AS slot"),
    }
    found, _ = references.foreign_keys_by_value(frames)
    best = {(r["child_table"], r["child_column"]): (r["parent_table"], r["parent_column"], r["same_name"]) for r in references.best_parents(found).collect()}
    # The name decides before the share of keys in use.
    assert best[("visits", "person_id")] == ("people", "id", True) and best[("slots", "slot")] == ("visits", "number", False)
    nothing, stats = references.foreign_keys_by_value({"a": frames["people"].where("false"), "b": frames["slots"].where("false")})
    assert nothing.count() == 0 and nothing.columns == found.columns and stats.pairs == 0
    none, _ = references.foreign_keys_by_value({"a": spark.createDataFrame([(1.5,)], "v double")})
    assert none.count() == 0


def test_no_agreeing_names_is_no_error(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert structure.fk_candidates({"a": one}).count() == 0
    assert structure.fk_candidates({"a": one, "b": one.toDF("x", "y")}).columns == [c.split()[0] for c in structure.FK_COLUMNS.split(", ")]
    rows = proposal.propose({"a": one}).collect()
    assert [(r["column"], r["is_pk"], r["ref_table"]) for r in sorted(rows, key=lambda r: r["pos"])] == [("k", True, None), ("v", False, None)]


@pytest.mark.parametrize("word", [
    "house", "series", "movie", "cache", "warehouse", "species", "status", "address", "box", "category", "batch", "cookie", "case",
    "cause", "clause", "tie", "purchase", "order", "bonus", "class", "key", "search", "niche", "order_status",
])
def test_singular_of_plural(word):
    assert singular(plural(word)) == word or plural(word) == word


def test_irregular_words():
    pairs = {
        "people": "person", "children": "child", "statuses": "status", "houses": "house", "movies": "movie", "caches": "cache",
        "series": "series", "addresses": "address", "data_series": "data_series", "cities": "city", "properties": "property", "bonuses": "bonus",
        "warehouses": "warehouse", "batches": "batch", "order_people": "order_person", "varieties": "variety",
    }
    assert {p: singular(p) for p in pairs} == pairs


def test_repeated_keys_in_updates(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sent = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "id int, v string, turn int")
    with pytest.raises(IntakeError, match="id = 1"):
        catalog.upsert(stored, sent.drop("turn"), ["id"])
    got = catalog.upsert(stored, sent, ["id"], latest=[sent["turn"]])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "y"), (2, "b"), (3, "z")]


@pytest.mark.parametrize(("cursor", "start"), [("²", 0), ("٣", 0), ("2", 2), ("-1", 0), ("x", 0), ("", 0), (1, 1), (None, 0)])
def test_offset_cursor(spark, cursor, start):
    page = browse.browse(spark.range(5), sort="id", cursor=cursor)
    assert [r["id"] for r in page.rows.collect()][:1] == [start]
