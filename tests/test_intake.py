"""File profiles, profiles that add up, and documents as they arrive."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rowmill.errors import BadEncoding
from rowmill.operators import sketches
from rowmill.plans.files import workbook_bytes
from rowmill.plans.intaking import _arrive
from rowmill.plans.profiles import profile_file
from rowmill.session import scratch_dir
from rowmill.sources.documents import read_document
from rowmill.streaming import intake


def shown(profile):
    r = profile.first()
    return r, {g["name"]: {c["name"]: c["samples"] for c in g["columns"]} for g in r["regions"]}


def test_delimited_folder_in_file_order(spark, tmp_path):
    folder = tmp_path / "sales.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("n,t\n" + "".join(f"{i},x{i // 2}\n" for i in range(9, -1, -1)))
    (folder / "b.csv").write_text("t,n\nlast,77\n")
    r, regions = shown(profile_file(spark, str(folder)))
    assert regions == {"default": {"n": ["9", "8", "7", "6", "5"], "t": ["x4", "x3", "x2", "x1", "x0"]}}
    assert (r["format"], r["encoding"], r["filename"], r["notes"]) == ("csv", "utf-8", "sales.csv", [])
    assert r["size_bytes"] == sum(os.path.getsize(folder / f) for f in ("a.csv", "b.csv")) and r["regions"][0]["row_count"] == 11


def test_samples_are_of_the_first_fifty_rows(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("k,v\n" + "".join(f"{i},{'' if i < 5 else 'same' if i < 60 else i}\n" for i in range(3000)))
    _, regions = shown(profile_file(spark, str(path)))
    # 55 filled cells say the same before the sixth value: only it is among the first fifty.
    assert regions["default"] == {"k": ["0", "1", "2", "3", "4"], "v": ["same"]}


def test_json_shapes_and_notes(spark, tmp_path):
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"shops": [{"s": 3}, {"s": 1}, {"s": 2}], "towns": [{"t": {"x": 1}}]}))
    (folder / "b.json").write_text('{"id": 5}\n{"id": 4}\n')
    (folder / "c.json").write_text(json.dumps([{"id": 9}, {"id": 8}], indent=1))
    (folder / "d.json").write_text("no json")
    r, regions = shown(profile_file(spark, str(folder)))
    assert regions == {"shops": {"s": ["3", "1", "2"]}, "towns": {"t": ['{"x":1}']}, "default": {"id": ["5", "4", "9", "8"]}}
    assert len(r["notes"]) == 1 and r["notes"][0].startswith("d.json")


def test_workbooks_carry_their_place(spark, tmp_path):
    folder = tmp_path / "books.xlsx"
    folder.mkdir()
    (folder / "a.xlsx").write_bytes(workbook_bytes({"one": [["k", "v"], [2, "b"], [1, "a"]], "none": []}))
    (folder / "b.xlsx").write_bytes(workbook_bytes({"one": [["v", "k"], ["c", 3]]}))
    _, regions = shown(profile_file(spark, str(folder)))
    assert regions == {"one": {"k": ["2", "1", "3"], "v": ["b", "a", "c"]}}
    rows = read_document(spark, str(folder), positions=True)[0]["one"].collect()
    assert sorted((r["_at"]["file"].rsplit("/", 1)[-1], r["_at"]["row"], r["k"]) for r in rows) == [("a.xlsx", 2, 2), ("a.xlsx", 3, 1), ("b.xlsx", 2, 3)]


def test_documents_without_rows_or_of_another_encoding(spark, tmp_path):
    (tmp_path / "e.json").write_text("  ")
    r = profile_file(spark, str(tmp_path / "e.json")).first()
    assert r["regions"] == [] and r["notes"] and r["size_bytes"] == 2
    for name, text in (("l.csv", "a,b\nÄ,1\n"), ("l.json", '{"a": "Ä"}\n{"a": "B"}\n')):
        (tmp_path / name).write_bytes(text.encode("latin-1"))
        with pytest.raises(BadEncoding):
            profile_file(spark, str(tmp_path / name)).collect()


def test_profiles_add_up(spark):
    store = scratch_dir(spark, "loads")
    first = spark.range(1000).selectExpr("id", "id % 7 AS k", "CASE WHEN id % 4 > 0 THEN cast(id % 50 AS string) END AS t")
    second = spark.range(500, 1500).selectExpr("id % 7 AS k", "id", "id * 0.5D AS more")
    sketches.add_load(spark, store, first, "a")
    sketches.add_load(spark, store, second, "b")
    sketches.add_load(spark, store, second, "b")
    got = {r["column"]: tuple(r)[2:] for r in sketches.merged_profile(sketches.stored_loads(spark, store)).collect()}
    assert {c: v[:2] for c, v in got.items()} == {"id": (2000, 0.0), "k": (2000, 0.0), "t": (2000, 0.625), "more": (2000, 0.5)}
    for column, exact in (("id", 1500), ("k", 7), ("t", 50), ("more", 1000)):
        assert abs(got[column][2] - exact) <= 0.03 * exact
    empty = sketches.merged_profile(sketches.load_profile(first.where("false"), "none")).collect()
    assert {tuple(r)[1:] for r in empty} == {("id", 0, 0.0, 0), ("k", 0, 0.0, 0), ("t", 0, 0.0, 0)}


def test_each_document_once(spark, tmp_path):
    inbox, log = tmp_path / "inbox", scratch_dir(spark, "log")
    (inbox / "1").mkdir(parents=True)
    (inbox / "2").mkdir()
    table = intake.catalogue_table(spark, scratch_dir(spark, "docs"), buckets=4)
    (inbox / "1" / "a.csv").write_text("k\n1\n")
    (inbox / "1" / "b.json").write_bytes(b"\xff\xfe")
    (inbox / "1" / "Copy.csv").write_text("k\n1\n")
    intake.take_in(intake.arriving_documents(spark, str(inbox)), table, log)
    # Names are of the first arrival, ties of time by name; a repeat in one batch counts too.
    assert {(r["ext"], r["note"], r["arrivals"]) for r in intake.listed(table).collect()} == {("csv", None, 2), ("json", "not UTF-8", 1)}
    (inbox / "2" / "a again.csv").write_text("k\n1\n")
    (inbox / "2" / "empty.tsv").write_text("")
    (inbox / "2" / "page.html").write_text("<p>")
    intake.take_in(intake.arriving_documents(spark, str(inbox)), table, log)
    rows = {r["ext"]: (r["note"], r["arrivals"], r["size_bytes"]) for r in intake.listed(table).collect()}
    assert rows == {"csv": (None, 3, 4), "json": ("not UTF-8", 1, 2), "html": ("unknown format", 1, 3)}
    assert [r["document"] for r in intake.listed(table, "PAGE").collect()] == ["page.html"]
    assert next(r["document"] for r in intake.listed(table).collect() if r["ext"] == "csv") != "a again.csv"
    # Nothing new.
    intake.take_in(intake.arriving_documents(spark, str(inbox)), table, log)
    assert {r["ext"]: r["arrivals"] for r in intake.listed(table).collect()}["csv"] == 3


def test_documents_are_written_and_listed_by_a_bounded_number_of_tasks(spark, tmp_path):
    customers = spark.range(1, 2001).select(F.col("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name"))
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    _arrive(spark, str(tmp_path), str(tmp_path / "inbox"), lambda c: c % 3 != 1)
    found = spark.read.text(str(tmp_path / "inbox")).select(F.col("_metadata.file_name").alias("f"), "chunk", "value")
    names = {r["f"].split("-")[1] for r in found.select("f").distinct().collect()}
    assert len(names) > 1
    assert found.select("chunk").distinct().count() == found.select("chunk", "f").distinct().count() == 27
    assert found.count() == customers.where("floor(c_custkey / 50) % 3 <> 1").count()
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 64
