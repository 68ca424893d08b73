"""Registered file queries: given tables are written out in some format and read back."""

from __future__ import annotations

import io
import sys
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.plans import views as V
from rowmill.plans.registry import query
from rowmill.session import materialize, scratch_dir
from rowmill.sources import delimited, documents, json_files, workbook
from rowmill.sources.tables import read_table

# Executors need not have this package installed: the workbook writer travels with its tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows per JSON document or workbook written here.
_CHUNK = 500


@query("SELECT * FROM part")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Comma separated text with inferred types gives the table back."""
    out = scratch_dir(spark, "part") + ".csv"
    read_table(spark, folder, "part").write.option("header", True).csv(out)
    return documents.read_document(spark, out)[0]["default"]


@query("SELECT * FROM customer")
def tsv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_dir(spark, "customer") + ".tsv"
    read_table(spark, folder, "customer").write.option("header", True).option("sep", "\t").csv(out)
    return documents.read_document(spark, out)[0]["default"]


@query("""SELECT doc_id, md5(' "a", b' || chr(13) || chr(10) || 'c' || chr(13) || text || ' ') AS digest, lang, source, n_chars
FROM documents""")
def quoted_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with commas, quotes, blanks at their ends and line breaks of all kinds survive quoting."""
    out = scratch_dir(spark, "documents") + ".csv"
    text = F.concat(F.lit(' "a", b\r\nc\r'), "text", F.lit(" "))
    docs = read_table(spark, folder, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    writer = docs.withColumn("text", text).write.option("header", True)
    writer = writer.option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out)
    back = delimited.read_csv(spark, out)
    return back.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), "lang", "source", F.col("n_chars").cast("int").alias("n_chars")
    )


def _ragged(spark: SparkSession, folder: str) -> str:
    """Orders as text lines; every order of status P misses its last field."""
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    line = F.concat_ws(",", "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    out = scratch_dir(spark, "ragged") + ".csv"
    o.select(line.alias("o_orderkey,o_custkey,o_orderstatus")).write.option("header", True).option("sep", "\t").csv(out)
    return out


@query("SELECT CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS VARCHAR) AS record FROM orders WHERE o_orderstatus = 'P'")
def ragged_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with too few fields go to quarantine as they were written."""
    return delimited.read_delimited(spark, _ragged(spark, folder))[1].select("record")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def whole_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that are not ragged, typed."""
    from rowmill.operators.infer import typed

    rows, _ = delimited.read_delimited(spark, _ragged(spark, folder))
    return typed(rows.drop(delimited.SOURCE))


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE c_nationkey = 3) AS bad_lines FROM customer")
def encoding_check(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are not UTF-8 in a file exported with another code page."""
    c = read_table(spark, folder, "customer", ["c_custkey", "c_name", "c_nationkey"])
    name = F.when(F.col("c_nationkey") == 3, F.concat("c_name", F.lit(" Öhm"))).otherwise(F.col("c_name"))
    out = scratch_dir(spark, "ansi") + ".csv"
    c.select("c_custkey", name.alias("c_name")).write.option("encoding", "ISO-8859-1").csv(out)
    report = delimited.inspect_text(spark, out)
    return report.agg(
        F.sum("lines").cast("long").alias("lines"), F.sum("bad_lines").cast("long").alias("bad_lines")
    )


def _documents(df: DataFrame, key: str, body, out: str) -> None:
    """One single-line JSON document per chunk of keys, each in a folder of its own."""
    docs = df.groupBy(F.floor(F.col(key) / _CHUNK).alias("chunk")).agg(body.alias("value"))
    docs.write.partitionBy("chunk").text(out)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_array(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are arrays of objects."""
    c = read_table(spark, folder, "customer", ["c_custkey", "c_name", "c_acctbal"])
    out = scratch_dir(spark, "array") + ".json"
    _documents(c, "c_custkey", F.to_json(F.collect_list(F.struct(*c.columns))), out)
    return documents.read_document(spark, out)[0]["default"]


@query("""SELECT 'names' AS region, c_custkey AS id, c_name AS value FROM customer
UNION ALL SELECT 'segments', c_custkey, c_mktsegment FROM customer""")
def json_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are objects of arrays: one region per key."""
    c = read_table(spark, folder, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    names = F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    segments = F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")))
    out = scratch_dir(spark, "regions") + ".json"
    _documents(c, "c_custkey", F.to_json(F.struct(names.alias("names"), segments.alias("segments"))), out)
    regions, _ = documents.read_document(spark, out)
    a = regions["names"].select(F.lit("names").alias("region"), "id", F.col("name").alias("value"))
    return a.unionByName(regions["segments"].select(F.lit("segments").alias("region"), "id", F.col("segment").alias("value")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM events")
def ndjson_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One object per line, every column; times come back as times, to the microsecond."""
    out = scratch_dir(spark, "events") + ".json"
    read_table(spark, folder, "events").write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(out)
    back = documents.read_document(spark, out)[0]["default"]
    return back.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("SELECT event_id, '{\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}' AS who FROM events")
def json_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Nested values are profiled and loaded as JSON text."""
    e = read_table(spark, folder, "events", ["event_id", "user_id", "event_type"])
    who = F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))
    out = scratch_dir(spark, "nested") + ".json"
    e.select("event_id", who.alias("who")).write.json(out)
    return json_files.flattened(json_files.read_json(spark, out)[0]["default"])


def _sheet(rows: list[list[object]]) -> str:
    out = []
    for cells in rows:
        parts = []
        for v in cells:
            if v is None:
                parts.append("<c/>")
            elif isinstance(v, str):
                parts.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
            else:
                parts.append(f"<c><v>{v!r}</v></c>")
        out.append(f"<row>{''.join(parts)}</row>")
    return f"<worksheet><sheetData>{''.join(out)}</sheetData></worksheet>"


def workbook_bytes(sheets: dict[str, list[list[object]]]) -> bytes:
    """A minimal workbook."""
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="urn:r"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(rows))
    return buffer.getvalue()


def _customer_book(chunk: pd.DataFrame) -> pd.DataFrame:
    names = [["id", "name", "balance"], *chunk[["c_custkey", "c_name", "c_acctbal"]].values.tolist()]
    segments = [["id", "segment"], *chunk[["c_custkey", "c_mktsegment"]].values.tolist()]
    content = workbook_bytes({"names": names, "empty": [], "segments": segments})
    return pd.DataFrame({"path": [f"{chunk['c_custkey'].min()}.xlsx"], "content": [content]})


@query("""SELECT 'names' AS region, c_custkey AS id, c_name AS value, c_acctbal AS balance FROM customer
UNION ALL SELECT 'segments', c_custkey, c_mktsegment, NULL FROM customer""")
def workbook_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Workbooks of up to 500 customers: one region per sheet, the empty sheet left out."""
    from rowmill.operators.infer import typed

    c = read_table(spark, folder, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    books = c.groupBy(F.floor(F.col("c_custkey") / _CHUNK)).applyInPandas(_customer_book, "path string, content binary")
    regions, _ = workbook.workbook_regions(materialize(workbook.workbook_cells(books), "workbook"))
    names, segments = typed(regions["names"]), typed(regions["segments"])
    a = names.select(F.lit("names").alias("region"), "id", F.col("name").alias("value"), "balance")
    b = segments.select(F.lit("segments").alias("region"), "id", F.col("segment").alias("value"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_orderkey, o_custkey, 3 AS documents FROM orders")
def document_collection(spark: SparkSession, folder: str) -> DataFrame:
    """Several files of one shape in one scan; each row knows its document."""
    out = scratch_dir(spark, "collection")
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey"])
    paths = []
    for i, name in enumerate(("a", "b", "c")):
        path = f"{out}/{name}.csv"
        o.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == i).write.option("header", True).csv(path)
        paths.append(path)
    rows = documents.read_collection(spark, paths)
    folder_name = F.element_at(F.split("document", "/"), -2)
    n = rows.agg(F.count_distinct(folder_name)).scalar()
    return rows.select(
        F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), n.cast("int").alias("documents")
    )


@query("SELECT 'csv' AS ext, 3 AS files, min(c_custkey) >= 0 AS filled FROM customer UNION ALL SELECT 'json', 2, min(n_nationkey) >= 0 FROM nation")
def document_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """File listing by extension, without reading contents."""
    out = scratch_dir(spark, "catalogue")
    read_table(spark, folder, "customer").repartition(3).write.csv(f"{out}/customer")
    read_table(spark, folder, "nation").repartition(2).write.json(f"{out}/nation")
    found = documents.document_catalogue(spark, out, search="PART-")
    return found.groupBy("ext").agg(
        F.count(F.lit(1)).cast("int").alias("files"), (F.min("size_bytes") > 0).alias("filled")
    )


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, o_custkey, CAST(nullif(id_s, '') AS BIGINT) AS id_s, email, order_date_s, amount_s, currency,
nullif(discount_s, '') AS discount_s, is_gift_s, nullif(notes, '') AS notes, qty_s,
strftime(CAST(left(created_at_s, 19) AS TIMESTAMP)
  - to_hours(CASE right(created_at_s, 6) WHEN '+01:00' THEN 1 WHEN '-07:00' THEN -7 WHEN '+09:00' THEN 9 ELSE 0 END),
  '%Y-%m-%d %H:%M:%S') AS created_at_s, address_s, empty_col FROM dirty_orders""")
def dirty_file(spark: SparkSession, folder: str) -> DataFrame:
    """A messy export read back, every column: numbers and times get types, mixed cells stay text as they were, empty ones are NULL."""
    out = scratch_dir(spark, "dirty") + ".csv"
    writer = V.dirty_orders(spark, folder).write.option("header", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out)
    back = documents.read_document(spark, out)[0]["default"]
    return back.withColumn("created_at_s", F.date_format("created_at_s", "yyyy-MM-dd HH:mm:ss")).withColumn("id_s", F.col("id_s").cast("bigint"))
