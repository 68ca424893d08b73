"""Registered profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators import infer, profile
from rowmill.plans import views as V
from rowmill.plans.registry import query
from rowmill.sources.tables import read_table, read_tables

CUSTOMER = [("c_custkey", "int"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "float"), ("c_mktsegment", "string")]
ORDERS = [
    ("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"), ("o_totalprice", "float"),
    ("o_orderdate", "datetime"), ("o_orderpriority", "string"),
]
DIRTY = [
    "id_s", "email", "order_date_s", "amount_s", "currency", "discount_s", "is_gift_s", "notes", "qty_s",
    "created_at_s", "address_s", "empty_col",
]


def column_profile_sql(table: str, columns: list[tuple[str, str]], region: str | None = None) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{region or table}' AS region, {i} AS pos, '{c}' AS column_name, '{t}' AS inferred_type,
        count(*) AS row_count, round_even((count(*) - count({c})) / count(*), 4) AS null_rate,
        count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS distinct_count FROM {table}"""
        for i, (c, t) in enumerate(columns)
    )


@query(column_profile_sql("customer", CUSTOMER) + " UNION ALL " + column_profile_sql("orders", ORDERS))
def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    tables = read_tables(spark, folder, ["customer", "orders"])
    out = profile.profile_tables(tables)
    return out.withColumnRenamed("column", "column_name")


_TEXTS = {
    "documents": [("doc_id", "int"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "int")],
    "pages": [("page_id", "int"), ("url", "string"), ("html", "string")],
    "conversations": [("conv_id", "int"), ("turn", "int"), ("role", "string"), ("text", "string")],
}


@query(" UNION ALL ".join(column_profile_sql(t, c) for t, c in _TEXTS.items()))
def profile_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Columns holding whole documents; long texts are compared by digest."""
    return profile.profile_tables(read_tables(spark, folder, _TEXTS)).withColumnRenamed("column", "column_name")


@query(f"WITH {V.DIRTY_ORDERS} " + column_profile_sql("cleaned", [(c, "string") for c in DIRTY]).replace(
    "FROM cleaned", "FROM (SELECT " + ", ".join(f"nullif(trim({c}), '') AS {c}" for c in DIRTY) + " FROM dirty_orders)"))
def profile_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Null rates and distinct counts of columns with gaps; NULL is one of the distinct values."""
    from rowmill.operators.clean import clean_text
    from rowmill.options import ImportOptions

    df = clean_text(V.dirty_orders(spark, folder).select(*DIRTY), ImportOptions(null_tokens=()))
    return profile.profile_tables({"cleaned": df}).withColumnRenamed("column", "column_name")


_SAMPLE_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, rank, value FROM (
      SELECT value, row_number() OVER (ORDER BY first_at) AS rank FROM (
        SELECT CAST({c} AS VARCHAR) AS value, min(p_partkey) AS first_at FROM (
          SELECT p_partkey, {c} FROM part WHERE {c} IS NOT NULL ORDER BY p_partkey LIMIT 50) GROUP BY 1)
    ) WHERE rank <= 5""" for c in _SAMPLE_COLUMNS))
def profile_samples(spark: SparkSession, folder: str) -> DataFrame:
    part = read_table(spark, folder, "part")
    return profile.samples(part, ["p_partkey"], _SAMPLE_COLUMNS).withColumnRenamed("column", "column_name")


@query("""SELECT 'customer' AS document, concat(count(*), ' rows · 5 columns') AS summary FROM customer
UNION ALL SELECT 'orders', concat(count(*), ' rows · 6 columns') FROM orders
UNION ALL SELECT 'geography', concat('2 regions', chr(10), '  - `nation`: ', (SELECT count(*) FROM nation), ' rows · 3 columns',
  chr(10), '  - `region`: ', (SELECT count(*) FROM region), ' rows · 2 columns')""")
def profile_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = read_tables(spark, folder, ["customer", "orders", "nation", "region"])
    docs = {"customer": ["customer"], "orders": ["orders"], "geography": ["nation", "region"]}
    rows = [
        profile.column_stats(t[n]).select(F.lit(d).alias("document"), F.lit(n).alias("region"), "row_count")
        for d, names in docs.items()
        for n in names
    ]
    return profile.profile_summary(profile.union_all(rows))


@query("""SELECT 'nation.parquet' AS filename, 'nation' AS region, count(*) AS row_count, 3 AS columns,
  string_agg(CASE WHEN n_nationkey < 5 THEN n_name END, '|' ORDER BY n_nationkey) AS name_samples FROM nation""")
def document_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Nested profile of one document, through its JSON form and back."""
    nation = read_table(spark, folder, "nation")
    regions = profile.region_profile(nation, ["n_nationkey"], "nation")
    doc = profile.document_profile(regions, f"{folder}/nation.parquet", 0, "csv")
    shape = doc.schema.simpleString()
    back = profile.profile_json(doc).select(F.from_json("profile", shape).alias("p")).select("p.*")
    region = back.select("filename", F.explode("regions").alias("r"))
    names = F.filter("r.columns", lambda c: c["name"] == "n_name")
    return region.select(
        "filename",
        F.col("r.name").alias("region"),
        F.col("r.row_count").alias("row_count"),
        F.size("r.columns").alias("columns"),
        F.concat_ws("|", F.element_at(names, 1)["samples"]).alias("name_samples"),
    )


@query("""SELECT o_orderpriority AS value, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share
FROM orders GROUP BY 1""")
def value_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_distribution(read_table(spark, folder, "orders", ["o_orderpriority"]), "o_orderpriority")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def find_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return profile.find_duplicates(read_table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH loads AS (FROM labels UNION ALL FROM labels WHERE quality = 1 UNION ALL FROM labels WHERE toxic = 1)
SELECT doc_id, quality, toxic, count(*) AS copies FROM loads GROUP BY ALL HAVING count(*) > 1""")
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicates by whole row, of all labels with two later loads that repeat some of them."""
    labels = read_table(spark, folder, "labels")
    return profile.find_duplicates(labels.unionByName(labels.where("quality = 1")).unionByName(labels.where("toxic = 1")))


_RE = {
    "int": r"^[+-]?[0-9]{1,18}$",
    "float": r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$",
    "bool": r"^(true|false)$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "datetime": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})$",
}


def _infer_sql(c: str) -> str:
    counts = ", ".join(
        f"count(*) FILTER (WHERE regexp_matches({'lower(' + c + ')' if k == 'bool' else c}, '{p}')) AS {k}_count"
        for k, p in _RE.items()
    )
    return f"""SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null, {counts},
      coalesce(max(length({c})), 0) AS max_length FROM src"""


@query(f"""WITH {V.DIRTY_ORDERS}, src AS (SELECT {", ".join(f"nullif(trim({c}), '') AS {c}" for c in DIRTY)} FROM dirty_orders),
counts AS ({" UNION ALL ".join(_infer_sql(c) for c in DIRTY)})
SELECT *, CASE WHEN non_null = 0 THEN 'null' WHEN bool_count = non_null THEN 'bool' WHEN int_count = non_null THEN 'int'
  WHEN float_count = non_null THEN 'float' WHEN date_count = non_null THEN 'date'
  WHEN date_count + datetime_count = non_null THEN 'datetime' ELSE 'string' END AS inferred_type,
  CASE WHEN non_null > 0 AND int_count = non_null THEN 'integer'
  WHEN non_null > 0 AND date_count + datetime_count = non_null THEN 'timestamptz' ELSE 'text' END AS load_type FROM counts""")
def infer_types(spark: SparkSession, folder: str) -> DataFrame:
    from rowmill.operators.clean import clean_text
    from rowmill.options import ImportOptions

    df = clean_text(V.dirty_orders(spark, folder).select(*DIRTY), ImportOptions(null_tokens=()))
    return infer.infer_types(df).drop("pos").withColumnRenamed("column", "column_name")


_FITS = "CASE WHEN min({c}) < -2147483648 OR max({c}) > 2147483647 THEN 'bigint' ELSE 'integer' END"


def load_type_sql(columns: list[tuple[str, str]]) -> list[str]:
    """SQL expression of each column's load type over its table."""
    fixed = {"string": "'text'", "float": "'double precision'", "datetime": "'timestamptz'"}
    return [_FITS.format(c=c) if kind == "int" else f"max({fixed[kind]})" for c, kind in columns]


EVENTS = [("event_id", "int"), ("ts", "datetime"), ("user_id", "int"), ("event_type", "string"), ("value", "float"), ("props", "string")]


@query(" UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS column_name, {kind} AS load_type FROM events"
    for i, ((c, _), kind) in enumerate(zip(EVENTS, load_type_sql(EVENTS), strict=True))))
def select_types(spark: SparkSession, folder: str) -> DataFrame:
    """Load type per stored column from its value range."""
    return infer.selected_load_types(read_table(spark, folder, "events")).withColumnRenamed("column", "column_name")
