"""Registered load and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators import clean, validate
from rowmill.options import ImportOptions
from rowmill.plans import importer
from rowmill.plans import views as V
from rowmill.plans.registry import query
from rowmill.session import scratch_dir
from rowmill.sources.tables import read_table, read_tables


@query("""SELECT false AS ok, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS total_rows,
concat('The report says 10 rows, the tables gained ', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation), '.') AS warnings,
'Table ''ghost'' is in the report, but was not loaded.' AS errors""")
def validate_load(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on a load that reported too few rows and a table that is not there."""
    tables = read_tables(spark, folder, ["customer", "nation", "orders"])
    out = validate.validate_load(spark, tables, ["customer", "ghost", "nation"], reported_rows=10)
    return out.select("ok", "total_rows", F.concat_ws("; ", "warnings").alias("warnings"), F.concat_ws("; ", "errors").alias("errors"))


@query(f"""WITH {V.DIRTY_ORDERS} SELECT 'dirty_orders' AS table_name, 'empty_col' AS column_name FROM dirty_orders
HAVING count(*) > 0 AND count(empty_col) = 0""")
def all_null_columns(spark: SparkSession, folder: str) -> DataFrame:
    tables = {"dirty_orders": V.dirty_orders(spark, folder), "customer": read_table(spark, folder, "customer")}
    return validate.all_null_columns(tables).withColumnsRenamed({"table": "table_name", "column": "column_name"})


@query(f"""WITH {V.ORPHAN_ORDERS} SELECT o_orderkey, o_custkey FROM orphan_orders
WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def orphan_fk(spark: SparkSession, folder: str) -> DataFrame:
    return validate.orphans(V.orphan_orders(spark, folder), "o_custkey", read_table(spark, folder, "customer"), "c_custkey")


@query(f"""WITH {V.ORPHAN_ORDERS}, lost AS (SELECT o_custkey AS v, count(*) AS n FROM orphan_orders WHERE o_custkey IS NOT NULL
AND o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1)
SELECT 'orders' AS table_name, 'o_custkey' AS column_name, CAST(sum(n) AS BIGINT) AS orphan_rows, count(*) AS orphan_values,
(SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (SELECT v FROM lost ORDER BY v LIMIT 3)) AS examples FROM lost
UNION ALL SELECT 'customer', 'c_nationkey', 0, 0, ''""")
def orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    tables = {**read_tables(spark, folder, ["customer", "nation"]), "orders": V.orphan_orders(spark, folder)}
    foreign = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]
    out = validate.orphan_report(tables, foreign)
    return out.withColumnsRenamed({"table": "table_name", "column": "column_name"})


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies, 'duplicate key' AS reason FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def key_violations(spark: SparkSession, folder: str) -> DataFrame:
    return validate.key_violations(read_table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""WITH {V.DIRTY_ORDERS} SELECT CAST(NULL AS VARCHAR) AS id_s, count(*) AS copies, 'null key' AS reason FROM dirty_orders
WHERE id_s = '' HAVING count(*) > 0""")
def null_keys(spark: SparkSession, folder: str) -> DataFrame:
    return validate.key_violations(clean.clean_text(V.dirty_orders(spark, folder).select("id_s")), ["id_s"])


@query(f"""WITH {V.DIRTY_ORDERS} SELECT 'qty_s' AS column_name, 'int' AS target, count(*) AS rejects FROM dirty_orders
WHERE NOT regexp_full_match(qty_s, '[0-9]+') HAVING count(*) > 0
UNION ALL SELECT 'id_s', 'int', count(*) FROM dirty_orders WHERE id_s <> '' AND NOT regexp_full_match(id_s, '[0-9]+') HAVING count(*) > 0""")
def type_sanity(spark: SparkSession, folder: str) -> DataFrame:
    """Cells per column that do not fit the column's target type."""
    df = clean.clean_text(V.dirty_orders(spark, folder).select("k", "id_s", "qty_s"))
    found = clean.cast_rejects(df, ["k"], {"id_s": "int", "qty_s": "int"})
    return found.groupBy(F.col("column").alias("column_name"), "target").agg(F.count(F.lit(1)).alias("rejects"))


@query("""SELECT concat('- `customer`: ', (SELECT count(*) FROM customer), ' rows', chr(10), '- `dirty_orders`: ',
(SELECT count(*) FROM orders), ' rows', chr(10), chr(10), 'Warnings:', chr(10),
'- Table ''dirty_orders'' has no value at all in empty_col') AS summary""")
def validation_summary(spark: SparkSession, folder: str) -> DataFrame:
    tables = {"dirty_orders": V.dirty_orders(spark, folder), "customer": read_table(spark, folder, "customer")}
    return validate.validation_summary(validate.table_checks(tables))


@query(f"""WITH {V.FLAT_SALES} SELECT CAST((SELECT count(*) FROM flat_sales) + (SELECT count(DISTINCT order_id) FROM flat_sales)
+ (SELECT count(DISTINCT customer_id) FROM flat_sales) + (SELECT count(DISTINCT part_id) FROM flat_sales) AS BIGINT) AS rows_imported,
'customers, orders, parts, sales' AS tables""")
def import_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The whole flow: flat sales typed, split, written, read back, checked, and placed beside the stored tables."""
    staging, live = scratch_dir(spark, "import-staging"), scratch_dir(spark, "import-live")
    done = importer.import_checked(spark, {"sales": V.flat_file(spark, folder)}, staging)
    written = {r["table"]: spark.read.parquet(f"{staging}/{r['table']}") for r in done.select("table").collect()}  # a row per table
    placed = importer.place_tables(spark, written, live)
    return placed.agg(F.sum("row_count").alias("rows_imported"), F.array_join(F.sort_array(F.collect_list("target")), ", ").alias("tables"))


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer
UNION ALL SELECT s_suppkey + 1000000, s_name, NULL FROM supplier""")
def append_compatible(spark: SparkSession, folder: str) -> DataFrame:
    """Rows added to a stored table as further files; a column that they lack is NULL."""
    live = scratch_dir(spark, "append")
    importer.place_tables(spark, {"customers": read_table(spark, folder, "customer", ["c_custkey", "c_name", "c_mktsegment"])}, live)
    s = read_table(spark, folder, "supplier")
    more = s.select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name"))
    importer.place_tables(spark, {"suppliers": more}, live)
    return spark.read.parquet(f"{live}/customers")


@query(f"""WITH {V.DIRTY_ORDERS} SELECT id_s, email, CASE WHEN upper(trim(notes)) IN ('N/A', 'NULL') THEN NULL
ELSE nullif(trim(notes), '') END AS notes FROM dirty_orders WHERE id_s <> ''""")
def import_options(spark: SparkSession, folder: str) -> DataFrame:
    """Default preparation under explicit instructions: null spellings, missing keys, names."""
    raw = V.dirty_orders(spark, folder).select(F.col("id_s").alias("Id S"), F.col("email").alias("E-mail"), F.col("notes").alias("Notes"))
    options = ImportOptions(null_tokens=("N/A", "NULL"), skip_null_keys=True)
    out = importer.prepare({"Dirty Order": raw}, options)["dirty_orders"]
    return out.withColumnRenamed("e_mail", "email")
