import io
import zipfile

import pytest
from pyspark.sql import functions as F

from rowmill.errors import BadEncoding, UnsupportedFormat
from rowmill.operators.profile import profile_columns
from rowmill.plans.files import workbook_bytes
from rowmill.sources import delimited, documents, json_files, workbook


def _types(df):
    return {r["column"]: (r["inferred_type"], r["null_rate"]) for r in profile_columns(df).collect()}


def test_csv_types_and_gaps(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("id,name,age,email\n1,Ann,31,ann@x.org\n2,Ben,,ben@x.org\n3,Cy,44,cy@x.org\n")
    regions, notes = documents.read_document(spark, str(path))
    assert notes == [] and list(regions) == ["default"]
    found = _types(regions["default"])
    assert found["id"] == ("int", 0.0)
    assert found["age"] == ("int", 0.3333)
    assert found["email"] == ("string", 0.0)


def test_tsv(spark, tmp_path, rows):
    path = tmp_path / "people.TSV"
    path.write_text("id\tname\n1\tAnn\n2\tBen, jr\n")
    regions, _ = documents.read_document(spark, str(path))
    assert rows(regions["default"]) == [(1, "Ann"), (2, "Ben, jr")]


def test_json_array(spark, tmp_path, rows):
    path = tmp_path / "people.json"
    path.write_text('[\n {"id": 1, "name": "Ann"},\n {"id": 2, "name": "Ben"}, {"id": 3, "name": null}\n]')
    regions, _ = documents.read_document(spark, str(path))
    assert list(regions) == ["default"]
    assert rows(regions["default"], "id", "name") == [(1, "Ann"), (2, "Ben"), (3, None)]


@pytest.mark.parametrize("indent", ["", "\n  "])
def test_json_object_of_arrays(spark, tmp_path, indent, rows):
    path = tmp_path / "shop.json"
    path.write_text(
        f'{{{indent}"customers": [{{"id": 1}}, {{"id": 2}}],{indent}'
        f'"orders": [{{"id": 7, "customer_id": 1}}, {{"id": 8, "customer_id": 2}}, {{"id": 9, "customer_id": 2}}]}}'
    )
    regions, _ = documents.read_document(spark, str(path))
    assert sorted(regions) == ["customers", "orders"]
    assert rows(regions["orders"], "id", "customer_id") == [(7, 1), (8, 2), (9, 2)]


def test_ndjson_keeps_every_line(spark, tmp_path):
    path = tmp_path / "events.json"
    path.write_text('{"id": 1, "kind": "a"}\n\n{"id": 2, "kind": "b"}\n{"id": 3, "kind": "a", "at": {"x": [1, 2]}}\n')
    assert json_files.json_shape(spark, str(path)) == "lines"
    regions, _ = documents.read_document(spark, str(path))
    df = regions["default"]
    assert df.count() == 3
    assert [r["at"] for r in df.orderBy("id").collect()] == [None, None, '{"x":[1,2]}']


@pytest.mark.parametrize("text", ["", "[]", "nonsense", '{"a": 1,\n "b": ', "[1, 2]"])
def test_json_without_a_shape_gives_a_note(spark, tmp_path, text):
    path = tmp_path / "odd.json"
    path.write_text(text)
    regions, notes = documents.read_document(spark, str(path))
    assert regions == {} and len(notes) == 1


def test_unknown_extension():
    with pytest.raises(UnsupportedFormat):
        documents.extension("x.parquet")
    assert documents.extension("/a.b/x.CSV") == "csv"
    with pytest.raises(UnsupportedFormat):
        documents.extension("/a.csv/x")


def test_other_code_page_is_refused(spark, tmp_path):
    path = tmp_path / "ansi.csv"
    path.write_bytes("id,name\n1,Östen\n".encode("windows-1252"))
    with pytest.raises(BadEncoding, match="ansi.csv"):
        documents.read_document(spark, str(path))


MESSY = '''id,address,note,gift
1,"5 Main St, Springfield","say ""hi""",Y
2,"7 Rue X
75002 Paris",,N
3,short,row
4,"   ","two
more
lines",yes
'''


def test_messy_csv(spark, tmp_path, rows):
    path = tmp_path / "messy.csv"
    path.write_text(MESSY)
    whole, ragged = delimited.read_delimited(spark, str(path))
    assert rows(whole, "id", "address", "note", "gift") == [
        ("1", "5 Main St, Springfield", 'say "hi"', "Y"),
        ("2", "7 Rue X\n75002 Paris", None, "N"),
        ("4", "   ", "two\nmore\nlines", "yes"),
    ]
    assert [r["record"].strip() for r in ragged.collect()] == ["3,short,row"]
    assert whole.count() == 3 and ragged.count() == 1


def test_collection_knows_its_documents(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(f"id,v\n1,{name}\n2,{name}\n")
    df = documents.read_collection(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    seen = {(r["document"].rsplit("/", 1)[-1], r["v"]) for r in df.collect()}
    assert seen == {("a.csv", "a"), ("b.csv", "b")}


def test_catalogue_search(spark, tmp_path):
    for name in ("Sales_2024.csv", "people.json", "noext"):
        (tmp_path / name).write_text("x")
    found = documents.document_catalogue(spark, str(tmp_path))
    assert {(r["document"], r["ext"], r["size_bytes"]) for r in found.collect()} == {
        ("Sales_2024.csv", "csv", 1), ("people.json", "json", 1), ("noext", "", 1)
    }
    assert [r["document"] for r in documents.document_catalogue(spark, str(tmp_path), "sales").collect()] == ["Sales_2024.csv"]


def test_workbook_regions_from_disk(spark, tmp_path):
    for i in (1, 2):
        book = workbook_bytes(
            {
                "customers": [["id", "name"], [i, f"N{i}"], [i + 10, "x & <y>"]],
                "nothing": [],
                "orders": [["id", "customer_id", "total"], [i, i, 1.5], [i + 5, i, 2.25], [i + 9, i, 3.0]],
            }
        )
        (tmp_path / f"shop{i}.xlsx").write_bytes(book)
    regions, notes = documents.read_document(spark, str(tmp_path), ext="xlsx")
    assert list(regions) == ["customers", "orders"] and notes == []
    assert regions["customers"].count() == 4 and regions["orders"].count() == 6
    assert dict(regions["orders"].dtypes) == {"id": "int", "customer_id": "int", "total": "double"}
    assert {r["name"] for r in regions["customers"].collect()} == {"N1", "N2", "x & <y>"}


def _rich_workbook() -> bytes:
    """Shared strings, a date style, a boolean, an error, a formula text and a sparse row."""
    parts = {
        "xl/workbook.xml": '<workbook xmlns:r="u"><sheets><sheet name="S" sheetId="1" r:id="rId9"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId9" Target="/xl/worksheets/one.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>day</t></si><si><r><t>fl</t></r><r><t>ag</t></r></si><si><t>err</t></si><si><t>calc</t></si></sst>",
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd hh:mm"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/one.xml": "<worksheet><sheetData>"
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="C3" t="s"><v>2</v></c><c r="E3" t="s"><v>3</v></c></row>'
        '<row r="4"><c r="A4" s="1"><v>45658</v></c><c r="B4" t="b"><v>1</v></c><c r="C4" t="e"><v>#N/A</v></c><c r="E4" t="str"><v>ok</v></c></row>'
        '<row r="5"/>'
        '<row r="6"><c r="A6" s="2"><v>45658.5</v></c><c r="E6"><v>7.0</v></c></row>'
        "</sheetData></worksheet>",
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buffer.getvalue()


def test_workbook_cells(spark, rows):
    files = spark.createDataFrame([("m.xlsx", bytearray(_rich_workbook()))], "path string, content binary")
    cells = workbook.workbook_cells(files)
    assert rows(cells, "row_no", "cells") == [
        (3, ["day", "flag", "err", None, "calc"]),
        (4, ["2025-01-01", "true", None, None, "ok"]),
        (6, ["2025-01-01 12:00:00", None, None, None, "7"]),
    ]
    regions, _ = workbook.workbook_regions(cells)
    assert regions["S"].columns == ["day", "flag", "err", "calc"]
    assert regions["S"].filter(F.col("flag").isNull()).count() == 1


def test_empty_workbook_gives_a_note(spark):
    files = spark.createDataFrame([("e.xlsx", bytearray(workbook_bytes({"a": []})))], "path string, content binary")
    assert workbook.workbook_regions(workbook.workbook_cells(files)) == ({}, ["No sheet of the workbook has cells."])
