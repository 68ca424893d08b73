import random

from pyspark.sql import functions as F

from rowmill.operators import infer, profile
from rowmill.options import ImportOptions
from rowmill.operators import structure


def test_profile_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "a", None)], "id int, s string, n string")
    found = {r["column"]: r.asDict() for r in profile.profile_columns(df).collect()}
    assert (found["s"]["null_rate"], found["s"]["distinct_count"]) == (0.3333, 2)
    assert (found["n"]["null_rate"], found["n"]["distinct_count"]) == (1.0, 1)
    assert (found["id"]["inferred_type"], found["id"]["distinct_count"], found["id"]["row_count"]) == ("int", 3, 3)


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, s string")
    found = profile.profile_columns(df).collect()
    assert {(r["column"], r["row_count"], r["null_rate"], r["distinct_count"]) for r in found} == {
        ("id", 0, 0.0, 0), ("s", 0, 0.0, 0)
    }


def test_type_names(spark):
    df = spark.sql(
        """SELECT 1Y a, 1S b, 1 c, 1L d, 1f e, 1d f, true g, date'2024-01-01' h, timestamp'2024-01-01' i, null j,
        'x' k, array(1) l, 1.5BD m"""
    )
    kinds = [infer.type_name(t) for _, t in df.dtypes]
    assert kinds == ["int"] * 4 + ["float"] * 2 + ["bool", "date", "datetime", "null", "string", "string", "string"]
    assert profile.profile_columns(df).count() == 13


def test_distinct_counts_against_brute_force(spark):
    rng = random.Random(7)
    data = [
        (
            rng.choice([None, *range(20)]),
            rng.choice([None, 0.5, 1.5, -0.0, 0.0]),
            rng.choice([None, "", "a", "b"]),
            rng.choice([True, False, None]),
        )
        for _ in range(400)
    ]
    df = spark.createDataFrame(data, "i int, d double, s string, b boolean").repartition(5)
    found = {r["column"]: r["distinct_count"] for r in profile.profile_columns(df).collect()}
    assert found == {c: len({row[i] for row in data}) for i, c in enumerate("idsb")}


def test_samples_take_the_first_fifty_cells(spark):
    data = [(i, None if i % 2 else f"v{i // 8}") for i in range(300)]
    df = spark.createDataFrame(data, "id int, v string").repartition(6)
    got = [(r["rank"], r["value"]) for r in profile.samples(df, ["id"], ["v"]).orderBy("rank").collect()]
    assert got == [(1, "v0"), (2, "v1"), (3, "v2"), (4, "v3"), (5, "v4")]
    late = spark.createDataFrame([(i, "same" if i < 60 else f"x{i}") for i in range(100)], "id int, v string")
    assert [r["value"] for r in profile.samples(late, ["id"], ["v"]).collect()] == ["same"]


def test_summary_text(spark):
    one = spark.createDataFrame([("d", "default", 3), ("d", "default", 3)], "document string, region string, row_count long")
    two = spark.createDataFrame([("e", "a", 1), ("e", "b", 2)], "document string, region string, row_count long")
    got = {r["document"]: r["summary"] for r in profile.profile_summary(one.union(two)).collect()}
    assert got == {"d": "3 rows · 2 columns", "e": "2 regions\n  - `a`: 1 rows · 1 columns\n  - `b`: 2 rows · 1 columns"}


def test_document_profile_nests(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, s string")
    regions = profile.region_profile(df, ["id"])
    doc = profile.document_profile(regions, "/tmp/a/people.csv", 12, "csv", "utf8", ["note"]).first()
    assert (doc["filename"], doc["size_bytes"], doc["notes"]) == ("people.csv", 12, ["note"])
    region = doc["regions"][0]
    assert (region["name"], region["row_count"]) == ("default", 2)
    assert [(c["name"], c["samples"]) for c in region["columns"]] == [("id", ["1", "2"]), ("s", ["x"])]


def test_inference_lattice(spark):
    data = [
        ("1", "1", "true", "2024-01-01", "2024-01-01", "1", None, "007", "99999999999", "1e3"),
        ("-2", "2.5", "FALSE", "2024-02-30", "2024-01-01T10:00:00Z", "x", None, "8", "1", ".5"),
    ]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in "abcdefghij"))
    found = {r["column"]: (r["inferred_type"], r["load_type"]) for r in infer.infer_types(df).collect()}
    assert found == {
        "a": ("int", "integer"),
        "b": ("float", "double precision"),
        "c": ("bool", "boolean"),
        "d": ("string", "text"),
        "e": ("datetime", "timestamptz"),
        "f": ("string", "text"),
        "g": ("null", "text"),
        "h": ("int", "integer"),
        "i": ("int", "bigint"),
        "j": ("float", "double precision"),
    }
    types = dict(infer.typed(df).dtypes)
    assert (types["a"], types["b"], types["c"], types["e"], types["i"]) == ("int", "double", "boolean", "timestamp", "bigint")


def test_long_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([("12345678901234567890",), ("1",)], "a string")
    assert infer.infer_types(df).first()["load_type"] == "text"


def test_long_texts_are_told_apart(spark):
    long = "x" * 70
    data = [(long + "a",), (long + "b",), (long + "a",), ("x" * 64,), ("x" * 65,), (None,)]
    df = spark.createDataFrame(data, "t string").repartition(3)
    assert profile.profile_columns(df).first()["distinct_count"] == 5


def test_inference_of_an_empty_table(spark):
    got = infer.infer_types(spark.createDataFrame([], "a string")).collect()
    assert [(r["column"], r["row_count"], r["inferred_type"]) for r in got] == [("a", 0, "null")]


def test_window_of_first_rows(spark):
    df = spark.createDataFrame([("1",)] * 5 + [("x",)], "a string").coalesce(1)
    assert infer.infer_types(df, first_rows=5).first()["inferred_type"] == "int"
    assert infer.infer_types(df).first()["inferred_type"] == "string"


def test_value_distribution_has_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    got = {r["value"]: (r["n"], r["share"]) for r in profile.value_distribution(df, "v").collect()}
    assert got == {"a": (2, 0.5), "b": (1, 0.25), None: (1, 0.25)}


def test_duplicates_group_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert [tuple(r) for r in profile.find_duplicates(df).collect()] == [(1, None, 2)]


def _sales(spark, n=60):
    rows = [
        (i, f"c{i % 5}@x.org", f"Name {i % 5}", None if i % 5 == 2 else "USA", f"SKU-{i % 4}", ["Pen", "Cup"][i % 4 % 2], i % 7)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "id int, customer_email string, customer_name string, customer_country string, product_sku string, product_name string, quantity int"
    )


def test_entities_of_a_flat_file(spark):
    evidence = structure.cluster_evidence(_sales(spark))
    assert structure.choose_entities(evidence) == {"customer": "customer_email", "product": "product_sku"}
    small = structure.cluster_evidence(_sales(spark, 20))
    assert structure.choose_entities(small) == {}


def test_gap_in_one_row_breaks_a_dependency(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None), (2, None)], "k int, v string")
    got = structure.functional_deps(df, "k", ["v"]).first()
    assert (got["groups"], got["violations"], got["holds"]) == (2, 1, False)


def test_prefixes_and_groups():
    names = ["id", "customer_email", "customer_name", "item_1_name", "item_1_qty", "item_2_name", "order_date"]
    assert structure.prefix_clusters(names) == {"customer": ["customer_email", "customer_name"]}
    groups, fields = structure.repeating_groups(names)
    assert groups == {1: {"name": "item_1_name", "qty": "item_1_qty"}, 2: {"name": "item_2_name"}}
    assert fields == ["name", "qty"]


def test_names_agree():
    assert structure.names_agree("orders", "customer_id", "customers", "id")
    assert structure.names_agree("orders", "o_custkey", "customer", "c_custkey")
    assert structure.names_agree("lineitem", "l_orderkey", "orders", "o_orderkey")
    assert not structure.names_agree("orders", "id", "customers", "id")
    assert not structure.names_agree("orders", "o_totalprice", "part", "p_size")


def test_foreign_key_needs_inclusion_and_a_unique_parent(spark):
    customers = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    orders = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "id int, customer_id int")
    notes = spark.createDataFrame([(1, 1), (2, 9)], "id int, customer_id int")
    doubled = customers.union(customers)
    tables = {"customers": customers, "orders": orders, "notes": notes}
    got = {(r["child_table"], r["parent_table"]): (r["matched"], r["coverage"], r["is_fk"]) for r in structure.fk_candidates(tables).collect()}
    assert got[("orders", "customers")] == (1, 1.0, True)
    assert got[("notes", "customers")] == (1, 0.5, False)
    again = structure.fk_candidates({"customers": doubled, "orders": orders})
    assert [r["is_fk"] for r in again.filter("parent_table = 'customers'").collect()] == [False]


def test_enum_columns_bound(spark):
    df = spark.createDataFrame([(f"s{i % 3}", f"t{i}", "x" * 40) for i in range(50)], "status string, title string, long string")
    got = structure.enum_columns(df, ImportOptions()).collect()
    assert [(r["column"], r["allowed"]) for r in got] == [("status", "s0|s1|s2")]


def test_keep_flat_reasons(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(40)], "id int, c int")
    got = {r["column"]: (r["decision"], r["reason"]) for r in structure.keep_flat(df, ["id", "c"]).collect()}
    assert got == {"id": ("flat", "no repetition"), "c": ("split", "repeated entity")}
    tiny = structure.keep_flat(df.limit(10), ["c"]).first()
    assert tiny["reason"] == "small document"


def test_reconcile_coverage(spark):
    new = spark.createDataFrame([("n", "id", "integer"), ("n", "name", "text")], "table string, column string, type string")
    old = spark.createDataFrame(
        [("people", "id", "integer"), ("people", "name", "text"), ("people", "age", "integer"), ("tags", "name", "text")],
        "table string, column string, type string",
    )
    got = {r["existing"]: (r["coverage"], r["compatible"]) for r in structure.reconcile(new, old).collect()}
    assert got == {"people": (1.0, True), "tags": (0.5, False)}


def test_stacked_cells_skip_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "a int, b string")
    ids, cells = profile.long_cells({"t": df})
    assert ids == [("t", "a"), ("t", "b")]
    assert cells.filter(F.col("cid") == 0).count() == 1 and cells.count() == 2


def test_samples_sort_no_more_than_the_first_rows(spark):
    """Columns with gaps, one almost empty, against the first fifty filled cells; no task sorts its rows."""
    rows = [(i, f"v{i % 7}", i if i % 9 == 0 else None, "late" if i == 390 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "at int, full string, some int, rare string").repartition(5)
    got = profile.samples(df, ["at"], ["full", "some", "rare"])
    want = {"full": [f"v{i}" for i in range(5)], "some": ["0", "9", "18", "27", "36"], "rare": ["late"]}
    assert sorted(tuple(r) for r in got.collect()) == sorted((c, n, v) for c, vs in want.items() for n, v in enumerate(vs, 1))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 3
    assert sorted(profile.samples(df.where("at < 3"), ["at"], ["rare", "full"]).select("column", "value").collect()) == [("full", f"v{i}") for i in range(3)]


def test_clusters_are_told_from_their_combinations(spark):
    """Evidence from rows grouped once is that from all rows, gaps and clusters without a key included."""
    rows = [(i % 6, f"n{i % 6}", None if i % 6 == 3 else "x", i % 4 or None, f"s{i % 4}", i, i % 9) for i in range(90)]
    df = spark.createDataFrame(rows, "who_id int, who_name string, who_land string, part_no int, part_name string, own_id int, own_kind int")
    plain, grouped = structure.cluster_evidence(df), structure.cluster_evidence(df, groups=structure.cluster_rows(df))
    assert sorted(plain.collect()) == sorted(grouped.collect())
    assert structure.choose_entities(grouped) == structure.choose_entities(plain) == {"who": "who_id", "part": "part_name"}
    empty = df.where("false")
    assert sorted(structure.cluster_evidence(empty, groups=structure.cluster_rows(empty)).collect()) == sorted(structure.cluster_evidence(empty).collect())
