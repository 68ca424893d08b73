import random

import pytest

from rowmill.errors import IntakeError
from rowmill.operators import normalize
from rowmill.operators.asof import asof_join, convert_currency
from rowmill.operators.ranking import first_per_group, numbered


def _groups(n=400, seed=3):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        g = "hot" if rng.random() < 0.4 else rng.choice([None, "a", "b", f"g{i % 9}"])
        data.append((g, rng.choice([None, rng.randrange(50)]), i))
    return data


def _expected(data):
    out, seen = set(), {}
    key = lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[2])
    for r in sorted(data, key=key):
        seen[r[0]] = seen.get(r[0], 0) + 1
        out.add((*r, seen[r[0]]))
    return out


def test_numbering_against_brute_force(spark):
    data = _groups()
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(6)
    got = {tuple(r) for r in numbered(df, ["g"], ["v", "i"], "n").collect()}
    assert got == _expected(data)


def test_numbering_without_a_group_is_dense(spark):
    data = list(range(0, 3000, 3))
    random.Random(1).shuffle(data)
    df = spark.createDataFrame([(x,) for x in data], "x int").repartition(7)
    got = sorted((r["id"], r["x"]) for r in normalize.surrogate_ids(df, ["x"]).collect())
    assert got == [(i + 1, x) for i, x in enumerate(sorted(data))]


def test_existing_name_is_refused(spark):
    with pytest.raises(IntakeError):
        normalize.surrogate_ids(spark.range(3), ["id"])


def test_first_per_group(spark):
    from pyspark.sql import functions as F

    data = _groups()
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(6)
    got = {tuple(r) for r in first_per_group(df, ["g"], [F.col("i").desc()], 3).collect()}
    by = {}
    for r in sorted(data, key=lambda r: -r[2]):
        by.setdefault(r[0], []).append(r)
    assert got == {r for rs in by.values() for r in rs[:3]}


def test_entity_and_child(spark, rows):
    df = spark.createDataFrame([(1, "a", "A"), (2, "b", "B"), (3, "a", "A"), (4, None, None)], "id int, k string, n string")
    parent = normalize.extract_entity(df, "k", ["n"])
    assert rows(parent) == [("a", "A"), ("b", "B")]
    ids = normalize.surrogate_ids(parent, ["k"], "k_id")
    child = normalize.fk_lookup(df.drop("n"), ids, "k", "k_id", "k_id")
    assert rows(child) == [(1, 1), (2, 2), (3, 1), (4, None)]


def test_inconsistent_entity_keeps_one_row(spark, rows):
    df = spark.createDataFrame([("a", "y", 1), ("a", "x", 2), ("b", None, 3)], "k string, p string, q int")
    assert rows(normalize.extract_entity(df, "k", ["p", "q"], consistent=False)) == [("a", "x", 2), ("b", None, 3)]


def test_unpivot_drops_empty_groups(spark, rows):
    df = spark.createDataFrame([(1, "a", 2, "b", None), (2, None, None, None, None)], "id int, item_1_name string, item_1_qty int, item_2_name string, item_2_qty int")
    assert rows(normalize.unpivot_groups(df, ["id"])) == [(1, 1, "a", 2), (1, 2, "b", None)]


def test_split_then_rebuild_is_lossless(spark):
    rng = random.Random(5)
    data = [(rng.randrange(6), rng.choice([None, "a", "b"])) for _ in range(80)]
    df = spark.createDataFrame([(q, k, f"n{k}" if k else None) for q, k in data], "q int, k string, n string")
    parent = normalize.extract_entity(df, "k", ["n"])
    again = normalize.rebuild(normalize.child_with_key(df, ["n"]), [(parent, "k")], df.columns)
    assert normalize.multiset_difference(df, again).isEmpty()
    one_less = df.limit(79)
    lost = normalize.multiset_difference(df, one_less).first()
    assert (lost["only_left"], lost["only_right"]) == (1, 0)


@pytest.mark.parametrize("bucket", ["month", "day"])
def test_asof_against_brute_force(spark, bucket):
    rng = random.Random(11)
    day = lambda: f"2024-{rng.randrange(1, 7):02d}-{rng.randrange(1, 28):02d}"
    left = [(i, "hot" if rng.random() < 0.5 else rng.choice(["x", "y", "z", None]), rng.choice([None, day()])) for i in range(300)]
    right = list({(k, day()): None for k in ("hot", "x", "y") for _ in range(12)})
    rates = [(k, d, float(i)) for i, (k, d) in enumerate(right)]
    a = spark.createDataFrame(left, "i int, k string, d string").selectExpr("i", "k", "cast(d as date) d")
    b = spark.createDataFrame(rates, "k string, day string, rate double").selectExpr("k", "cast(day as date) day", "rate")
    got = {r["i"]: r["rate"] for r in asof_join(a, b, ["k"], "d", "day", ["rate"], bucket).collect()}

    def latest(k, d):
        held = [(day, rate) for kk, day, rate in rates if kk == k and d is not None and day <= d]
        return max(held)[1] if held else None

    assert got == {i: latest(k, d) for i, k, d in left}


def test_base_currency_needs_no_rate(spark):
    df = spark.createDataFrame([(1, 10.0, "USD"), (2, 10.0, "EUR"), (3, 10.0, "GBP")], "i int, a double, c string").selectExpr("*", "date'2024-02-01' AS d")
    rates = spark.createDataFrame([("EUR", 1.5)], "currency string, rate double").selectExpr("currency", "date'2024-01-01' AS day", "rate")
    got = {r["i"]: r["usd"] for r in convert_currency(df, rates, "a", "c", "d", "usd").collect()}
    assert got == {1: 10.0, 2: 15.0, 3: None}


def test_asof_with_fine_times_of_one_hot_key(spark):
    """Times in microseconds, nearly all of one key: no task holds the key's whole history."""
    rng = random.Random(5)
    marks = sorted(rng.sample(range(10**9), 3000))
    asked = [rng.randrange(10**9) for _ in range(3000)] + marks[:50]
    keys = ["hot"] * 2900 + ["x"] * 100
    stamp = "timestamp_micros(at) AS at"
    left = spark.createDataFrame([(i, "hot" if i % 20 else "x", t) for i, t in enumerate(asked)], "i int, k string, at bigint").selectExpr("i", "k", stamp)
    right = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(zip(keys, marks, strict=True))], "k string, at bigint, v int").selectExpr("k", "timestamp_micros(at) AS since", "v")
    got = {r["i"]: r["v"] for r in asof_join(left, right, ["k"], "at", "since", ["v"]).collect()}

    def latest(k, t):
        held = [(m, n) for n, (kk, m) in enumerate(zip(keys, marks, strict=True)) if kk == k and m <= t]
        return max(held)[1] if held else None

    assert got == {i: latest("hot" if i % 20 else "x", t) for i, t in enumerate(asked)}
