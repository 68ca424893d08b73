"""Folders whose files differ: shapes of JSON, headers and line breaks of delimited text; exact keys of long tables."""

import json

from pyspark.sql import functions as F

from rowmill.functions import convert as C
from rowmill.operators import clean, structure
from rowmill.operators.profile import region_profile, samples
from rowmill.operators.proposal import propose
from rowmill.options import ImportOptions
from rowmill.sources.delimited import SOURCE, read_delimited
from rowmill.sources.json_files import json_shape, read_json


def test_every_json_file_by_its_own_shape(spark, tmp_path, rows):
    (tmp_path / "a b.json").write_text(json.dumps([{"id": 1}, {"id": 2}], indent=2))
    (tmp_path / "b.json").write_text('{"id": 3}\n{"id": 4}\n\n{"id": 5}\n')
    (tmp_path / "c.json").write_text(json.dumps({"shops": [{"s": 1}], "towns": [{"t": "x"}]}, indent=1))
    (tmp_path / "d.json").write_text('{"id": "six"}')
    (tmp_path / "e.json").write_text("hello")
    (tmp_path / "f.json").write_text('{"shops": [{"s": 2}]}')
    found, notes = read_json(spark, str(tmp_path))
    assert rows(found["default"]) == [("1",), ("2",), ("3",), ("4",), ("5",), ("six",)]
    assert rows(found["shops"]) == [(1,), (2,)] and rows(found["towns"]) == [("x",)]
    assert len(notes) == 1 and notes[0].startswith("e.json")
    assert json_shape(spark, str(tmp_path)) == "mixed"


def test_every_delimited_file_by_its_own_header(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('id,name\n1,one\n2,"5"" pipe"\n')
    (tmp_path / "b.csv").write_text("name,id\nthree,3\n")
    (tmp_path / "c.csv").write_text('id,name\n4,"two\nlines"\n5\n')
    (tmp_path / "d.csv").write_text("id,other\n6,x\n")
    whole, ragged = read_delimited(spark, str(tmp_path))
    assert rows(whole.drop(SOURCE)) == [("1", "one"), ("2", '5" pipe'), ("3", "three"), ("4", "two\nlines")]
    assert rows(ragged.select("record")) == [("5",), ("6,x",)]


def test_one_gap_in_many_rows_rules_a_key_out(spark):
    df = spark.range(30_000).select(F.when(F.col("id") != 7, F.col("id")).alias("gap"), F.col("id").alias("full"))
    keys = {r["column"]: r["is_key"] for r in structure.candidate_keys({"t": df}).collect()}
    assert keys == {"gap": False, "full": True}
    proposed = {r["column"]: (r["nullable"], r["is_pk"]) for r in propose({"t": df}, infer_foreign=False).collect()}
    assert proposed == {"gap": (True, False), "full": (False, True)}


def test_enumerations_show_their_values(spark):
    long = "x" * 70
    df = spark.createDataFrame([(long, "y" * 200), ("b", "c"), (None, None)], "a string, b string")
    got = {r["column"]: (r["max_length"], r["allowed"]) for r in structure.enum_columns(df, ImportOptions(enum_max_length=100)).collect()}
    assert got == {"a": (70, f"b|{long}")}


def test_samples_of_a_composite_order(spark):
    df = spark.range(120).select((F.col("id") % 2).alias("a"), F.col("id").alias("b"), (F.col("id") % 3).cast("string").alias("c"))
    got = {r["column"]: r["samples"] for r in region_profile(df, ["a", "b"]).collect()}
    assert got == {"a": ["0"], "b": ["0", "2", "4", "6", "8"], "c": ["0", "2", "1"]}
    assert samples(df.filter("false"), ["b"]).count() == 0


def test_cells_are_read_whole_or_rejected(spark):
    cells = ["12,50", "1.234,56", "5$5", "1,2,3", "$1.999", "$1,234.50", "-€5", "€-5.5", "--5", "12:30:00", "2024", "2024-01-01 junk", "2024-01-01T10:00:00+02:00", "12d", "NaN", "7.5%", "%7", "1e3", "+4", None]
    df = spark.createDataFrame([(c,) for c in cells], "s string")
    s = F.col("s")
    read = {
        r["s"]: (r["amount"], r["percent"], r["at"])
        for r in df.select("s", C.to_amount(s).cast("string").alias("amount"), C.to_percent(s).cast("double").alias("percent"), C.to_timestamp(s).cast("string").alias("at")).collect()
    }
    assert {k: v[0] for k, v in read.items() if v[0]} == {"$1,234.50": "1234.50", "-€5": "-5.00", "€-5.5": "-5.50", "2024": "2024.00", "+4": "4.00"}
    assert {k: v[1] for k, v in read.items() if v[1]} == {"7.5%": 0.075}
    assert {k: v[2] for k, v in read.items() if v[2]} == {"2024-01-01T10:00:00+02:00": "2024-01-01 08:00:00"}
    lost = {t: {r["value"] for r in clean.cast_rejects(df, [], {"s": t}).collect()} for t in ("double", "date", "int")}
    assert set(cells) - lost["double"] == {"2024", "1e3", "+4", None}
    assert set(cells) - lost["date"] == {None} and set(cells) - lost["int"] == {"2024", "+4", None}


def test_decimal_filters_are_exact(spark):
    from rowmill.operators.browse import predicate

    df = spark.sql("SELECT CAST('9007199254740993.01' AS DECIMAL(20, 2)) AS d")
    assert df.filter(predicate(df, ["d:eq:9007199254740993.01"])).count() == 1
    assert df.filter(predicate(df, ["d:eq:9007199254740993.02"])).count() == 0


def test_batches_of_other_widths_join_a_table(spark, tmp_path, rows):
    import pytest

    from rowmill.errors import Conflict
    from rowmill.operators.versions import VersionStore

    store = VersionStore(spark, str(tmp_path))
    store.load({"t": spark.sql("SELECT 1 AS i, 1L AS l, 1.5D AS d")})
    store.append("t", spark.sql("SELECT 2L AS i, 2 AS l, 2 AS d"))
    assert rows(store.read("t")) == [(1, 1, 1.5), (2, 2, 2.0)]
    assert store.read("t").dtypes == [("i", "int"), ("l", "bigint"), ("d", "double")]
    for bad in ("SELECT 3000000000L AS i", "SELECT 'x' AS i", "SELECT 1.5D AS l", "SELECT 1 AS other"):
        with pytest.raises(Conflict):
            store.append("t", spark.sql(bad))


def test_repeated_and_blank_headers_of_a_sheet(spark, rows):
    from rowmill.plans.files import workbook_bytes
    from rowmill.sources import workbook

    book = workbook_bytes({"S": [["id", "x", "x", None, "y"], [1, 2, 3, 4, 5, 6], [7, 8]]})
    files = spark.createDataFrame([("b.xlsx", bytearray(book))], "path string, content binary")
    found = workbook.workbook_regions(workbook.workbook_cells(files))[0]["S"]
    assert found.columns == ["id", "x", "x_2", "column_4", "y", "column_6"]
    assert rows(found) == [("1", "2", "3", "4", "5", "6"), ("7", "8", None, None, None, None)]
