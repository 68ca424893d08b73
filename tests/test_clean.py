from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowmill.functions import convert as C
from rowmill.functions import names
from rowmill.operators import clean, infer
from rowmill.options import ImportOptions


def _one(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_blanks_and_null_spellings(spark):
    got = _one(spark, C.cleaned, "", "  ", "\t\n", " n/a ", "NULL", "null", " a b ", None, "N/A x")
    assert got == [None, None, None, None, None, None, "a b", None, "N/A x"]
    df = spark.createDataFrame([("-", 1)], "s string, n int")
    assert clean.clean_text(df, ImportOptions(null_tokens=("-",))).first() == (None, 1)


def test_booleans(spark):
    got = _one(spark, C.to_boolean, "Y", "no", "T", "FALSE", "1", "0", "N/A", "f", None)
    assert got == [True, False, True, False, True, False, None, False, None]


def test_dates(spark):
    got = _one(spark, lambda c: C.to_date(c).cast("string"), "2025-01-15", "01/22/2025", "22/01/2025", "2025-02-30", " 2025-03-01 ", "x", None)
    assert got == ["2025-01-15", "2025-01-22", None, None, "2025-03-01", None, None]


def test_offset_timestamps(spark):
    got = _one(spark, lambda c: C.to_timestamp(c).cast("string"), "2025-01-16T14:55:00+01:00", "2025-01-15T10:23:00Z", "2025-01-18T19:30:00-07:00", "x")
    assert got == ["2025-01-16 13:55:00", "2025-01-15 10:23:00", "2025-01-19 02:30:00", None]


def test_amounts(spark):
    got = _one(spark, C.to_amount, "$19.99", "€25.50", "¥3200", "1,200.00", "-5", "free", None)
    assert got == [Decimal("19.99"), Decimal("25.50"), Decimal("3200.00"), Decimal("1200.00"), Decimal("-5.00"), None, None]
    df = spark.createDataFrame([("¥45", "CNY"), ("¥1", "JPY"), ("$1", "EUR"), ("5", "EUR")], "a string, c string")
    assert [r[0] for r in df.select(C.symbol_fits_code(F.col("a"), F.col("c"))).collect()] == [True, True, False, None]


def test_percent_and_rescale(spark):
    assert [float(v) if v is not None else None for v in _one(spark, C.to_percent, "7.5%", "0%", "100%", "x")] == [0.075, 0.0, 1.0, None]
    df = spark.createDataFrame([(19.99,), (0.1,), (None,)], "p double")
    assert [r[0] for r in df.select(C.rescale(F.col("p"))).collect()] == [1999, 10, None]


def test_composite_parts(spark):
    assert _one(spark, lambda c: C.part_of(c, 1), "a, b", "a", "a,,c") == ["b", None, None]


def test_rejects_name_the_lost_cells(spark, rows):
    df = spark.createDataFrame([(1, "5", "Y"), (2, "12abc", "N"), (3, None, "maybe"), (4, "1.5", None)], "id int, q string, g string")
    targets = {"q": "int", "g": C.to_boolean}
    assert rows(clean.try_convert(df, targets)) == [(1, 5, True), (2, None, False), (3, None, None), (4, None, None)]
    assert rows(clean.cast_rejects(df, ["id"], targets, {"g": "boolean"})) == [
        (2, "q", "12abc", "int"), (3, "g", "maybe", "boolean"), (4, "q", "1.5", "int")
    ]


def test_strict_cast_aborts(spark):
    df = spark.createDataFrame([("1",), ("x",)], "a string")
    with pytest.raises(PySparkException):
        infer.apply_types(df, {"a": "integer"}).collect()


def test_required_and_keys(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (None, "c", "d")], "id int, a string, b string")
    assert rows(clean.missing_required(df, ["id"], ["a", "b"])) == [(1, "b"), (2, "a"), (2, "b")]
    kept, counts = clean.skip_null_keys(df, ["id"])
    assert kept.count() == 2 and tuple(counts.first()) == (2, 1)


def test_dedupe_keeps_the_first_in_order(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 1), (None, 1, 2), (None, 2, 1)], "k string, i int, v int")
    assert rows(clean.dedupe_by_key(df, ["k"], [F.col("v").desc()])) == sorted([("a", 2, 7), ("b", 1, 1), (None, 1, 2)], key=repr)


def test_fill_keeps_types(spark):
    df = spark.createDataFrame([(None, None)], "a int, b date")
    out = clean.fill_missing(df, {"a": 3, "b": "2024-01-01"})
    assert out.dtypes == df.dtypes and str(out.first()["b"]) == "2024-01-01"


def test_names(spark):
    assert names.snake(" Order No. (EU) ") == "order_no_eu"
    assert [names.plural(n) for n in ("customer", "category", "address", "box", "day", "sales")] == [
        "customers", "categories", "addresses", "boxes", "days", "sales"
    ]
    assert [names.singular(n) for n in ("customers", "categories", "addresses")] == ["customer", "category", "address"]
    df = spark.createDataFrame([(1, 2, 3, 4)], ["A b", "a-b", "a_b_2", "!"])
    assert names.normalized(df).columns == ["a_b", "a_b_2", "a_b_2_2", "column"]
    assert _one(spark, names.slug, "My Shop!", "***", "x" * 40) == ["my_shop", "project", "x" * 32]
