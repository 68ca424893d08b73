"""Registered queries of dispatch, bounds, reports and deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.errors import BadFilter, UnsupportedFormat
from rowmill.operators import asof, browse, catalog, changes, profile, runlog, validate
from rowmill.operators.profile import union_all
from rowmill.plans import importer
from rowmill.plans import views as V
from rowmill.plans.registry import query
from rowmill.session import scratch_dir
from rowmill.sources import documents
from rowmill.sources.tables import read_table, read_tables


@query(" UNION ALL ".join(f"SELECT '{e}' AS ext, n_nationkey, n_name FROM nation" for e in ("CSV", "tsv", "Json"))
       + " UNION ALL SELECT 'pdf refused', count(*), NULL FROM nation")
def format_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """A table in three formats is read by the extension of its file, in any case; another extension is refused."""
    n = read_table(spark, folder, "nation", ["n_nationkey", "n_name"])
    out, parts = scratch_dir(spark, "dispatch"), []
    n.write.option("header", True).csv(f"{out}/a.CSV")
    n.write.option("header", True).option("sep", "\t").csv(f"{out}/a.tsv")
    n.write.json(f"{out}/a.Json")
    for ext in ("CSV", "tsv", "Json"):
        rows = documents.read_document(spark, f"{out}/a.{ext}")[0]["default"]
        parts.append(rows.select(F.lit(ext).alias("ext"), F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name"))
    try:
        documents.extension("a.pdf")
    except UnsupportedFormat:
        count = n.agg(F.count(F.lit(1)).alias("n_nationkey"))
        parts.append(count.select(F.lit("pdf refused").alias("ext"), "n_nationkey", F.lit(None).cast("string").alias("n_name")))
    return union_all(parts)


_LIMITS = (-1, 0, 1, 100, 500, 501)


@query(" UNION ALL ".join(
    f"SELECT {n} AS page_limit, {'least(count(*), ' + str(n) + ')' if 1 <= n <= 500 else 'max(-1::BIGINT)'} AS page_rows FROM customer" for n in _LIMITS))
def limit_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a page for limits inside and outside the bounds; -1 where the limit is refused."""
    c, pages = read_table(spark, folder, "customer"), []
    for n in _LIMITS:
        try:
            rows = browse.browse(c, keys=["c_custkey"], limit=n).rows.agg(F.count(F.lit(1)).alias("page_rows"))
        except BadFilter:
            rows = c.agg(F.lit(-1).cast("bigint").alias("page_rows"))
        pages.append(rows.select(F.lit(n).alias("page_limit"), "page_rows"))
    return union_all(pages)


@query("""SELECT false AS ok, (SELECT count(*) FROM customer WHERE c_custkey < 0) + (SELECT count(*) FROM nation WHERE n_nationkey < 0) AS total_rows,
'' AS warnings, 'The load has no rows.' AS errors""")
def nothing_imported(spark: SparkSession, folder: str) -> DataFrame:
    """A load whose tables are all there, but have no rows, is no success."""
    c, n = read_table(spark, folder, "customer").where("c_custkey < 0"), read_table(spark, folder, "nation").where("n_nationkey < 0")
    out = validate.validate_load(spark, {"customer": c, "nation": n}, ["customer", "nation"])
    return out.select("ok", "total_rows", F.concat_ws("; ", "warnings").alias("warnings"), F.concat_ws("; ", "errors").alias("errors"))


@query("""SELECT 'update' AS kind, count(*) FILTER (c_acctbal < 0) AS affected_rows, count(*) AS total_rows FROM customer
UNION ALL SELECT 'delete', count(*) FILTER (c_mktsegment = 'BUILDING'), count(*) FROM customer
UNION ALL SELECT 'insert', (SELECT count(*) FROM supplier), count(*) FROM customer
UNION ALL SELECT 'drop_column', NULL, count(*) FROM customer UNION ALL SELECT 'rename_column', NULL, count(*) FROM customer""")
def affected_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of rows have a count of affected rows, changes of the schema have none."""
    c = read_table(spark, folder, "customer")
    s = read_table(spark, folder, "supplier").selectExpr("s_suppkey AS c_custkey", "s_name AS c_name")
    wanted = (
        changes.Change("customer", "update", where="c_acctbal < 0", values={"c_acctbal": "0"}),
        changes.Change("customer", "delete", where="c_mktsegment = 'BUILDING'"),
        changes.Change("customer", "insert", rows=s),
        changes.Change("customer", "drop_column", values={"c_acctbal": ""}),
        changes.Change("customer", "rename_column", values={"c_name": "c_title"}),
    )
    return union_all([x.dry_run(c).select(F.lit(x.kind).alias("kind"), "affected_rows", "total_rows") for x in wanted])


@query(f"""WITH {V.DIRTY_ORDERS} SELECT false AS ok, concat('- `customer`: ', (SELECT count(*) FROM customer), ' rows', chr(10),
'- `dirty_orders`: ', (SELECT count(*) FROM orders), ' rows', chr(10), chr(10), 'Warnings:', chr(10),
'- Table ''dirty_orders'' has no value at all in empty_col', chr(10), '- The report says 7 rows, the tables gained ',
(SELECT count(*) FROM customer) + (SELECT count(*) FROM orders), '.') AS summary,
'Table ''ghost'' is in the report, but was not loaded.' AS errors""")
def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    """What is said of a load with an empty column, another number of rows than reported, and a table that is missing."""
    tables = {"dirty_orders": V.dirty_orders(spark, folder), "customer": read_table(spark, folder, "customer")}
    reported = ["customer", "ghost", "dirty_orders"]
    verdict = validate.validate_load(spark, tables, reported, reported_rows=7)
    out = validate.validation_report(verdict, validate.table_checks(tables), reported)
    return out.select("ok", "summary", F.concat_ws("; ", "errors").alias("errors"))


@query("""SELECT 'geography' AS document, concat('2 regions', chr(10), '  - `region`: ', (SELECT count(*) FROM region), ' rows · 2 columns',
chr(10), '  - `nation`: ', (SELECT count(*) FROM nation), ' rows · 3 columns') AS summary
UNION ALL SELECT 'blank', 'No regions detected.' UNION ALL SELECT 'people', concat(count(*), ' rows · 5 columns') FROM customer""")
def profile_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries with regions in the order of the document, and of a document without any."""
    t = read_tables(spark, folder, ["customer", "nation", "region"])
    inside = {"people": ["customer"], "geography": ["region", "nation"], "blank": []}
    rows = [
        profile.column_stats(t[n]).select(F.lit(d).alias("document"), F.lit(n).alias("region"), F.lit(i).alias("place"), "row_count")
        for d, names in inside.items()
        for i, n in enumerate(names)
    ]
    named = spark.createDataFrame([(d,) for d in inside], "document string")
    return profile.profile_summary(union_all(rows), documents=named, place="place")


@query(f"""WITH {V.RUNS}, {V.STEPS_SQL}, gone AS (SELECT n_nationkey AS project_id FROM nation WHERE n_nationkey % 5 = 2),
ended AS (SELECT run_id FROM runs WHERE project_id IN (SELECT project_id FROM gone))
SELECT 'projects' AS table_name, count(*) AS row_count FROM nation WHERE n_nationkey NOT IN (SELECT project_id FROM gone)
UNION ALL SELECT 'runs', count(*) FROM runs WHERE project_id NOT IN (SELECT project_id FROM gone)
UNION ALL SELECT 'documents', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT project_id FROM gone)
UNION ALL SELECT 'steps', count(*) FROM raw_steps WHERE run_id NOT IN (SELECT run_id FROM ended)
UNION ALL SELECT 'snapshots to drop', count(snapshot) FROM (SELECT CASE WHEN status = 'completed' THEN 'v' END AS snapshot FROM runs
  WHERE run_id IN (SELECT run_id FROM ended))""".replace(f", {V.STEPS_SQL}", f", {V.RAW_STEPS}"))
def delete_project(spark: SparkSession, folder: str) -> DataFrame:
    """Projects deleted with all that hangs on them, and the snapshots that go."""
    projects = V.projects(spark, folder)
    left, dropped = runlog.delete_projects(
        projects, V.runs(spark, folder), {"documents": V.run_documents(spark, folder)}, {"steps": V.raw_steps(spark, folder)},
        projects.where("project_id % 5 = 2").select("project_id"),
    )
    counts = catalog.row_counts({**left, "snapshots to drop": dropped})
    return counts.withColumnRenamed("table", "table_name")


@query("""SELECT 'clients' AS table_name, 'people' AS target, 'append' AS action, (SELECT count(*) FROM supplier) AS row_count,
(SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS stored_rows
UNION ALL SELECT 'regions', 'regions', 'create', (SELECT count(*) FROM region), (SELECT count(*) FROM region)
UNION ALL SELECT 'places', 'places_2', 'create', (SELECT count(*) FROM nation), (SELECT count(*) FROM nation)""")
def place_tables(spark: SparkSession, folder: str) -> DataFrame:
    """New tables are added to the stored table that they fit, or stored beside."""
    live = scratch_dir(spark, "live")
    read_table(spark, folder, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance").write.parquet(f"{live}/people")
    read_table(spark, folder, "nation").selectExpr("n_name AS other").write.parquet(f"{live}/places")
    incoming = {
        "clients": read_table(spark, folder, "supplier").selectExpr("s_name AS name", "s_suppkey AS id"),
        "regions": read_table(spark, folder, "region"),
        "places": read_table(spark, folder, "nation").selectExpr("n_nationkey AS id", "n_name AS place"),
    }
    placed = importer.place_tables(spark, incoming, live)
    stored = catalog.row_counts({t: spark.read.parquet(f"{live}/{t}") for t in ("people", "regions", "places_2")})
    stored = stored.select(F.col("table").alias("target"), F.col("row_count").alias("stored_rows"))
    return placed.join(stored, "target").select(F.col("table").alias("table_name"), "target", "action", "row_count", "stored_rows")


@query(f"""WITH {V.RUN_EVENTS}, rates AS (SELECT user_id AS run_id, ts, event_id AS rate FROM events WHERE event_id % 3 = 0)
SELECT e.run_id, e.event_id, (SELECT max_by(r.rate, r.ts) FROM rates r WHERE r.run_id = e.run_id AND r.ts <= e.ts) AS rate FROM run_events e""")
def asof_fine(spark: SparkSession, folder: str) -> DataFrame:
    """Each event with the latest marked event of its run, by times in microseconds."""
    events = V.run_events(spark, folder).select("run_id", "event_id", "ts")
    marks = events.where("event_id % 3 = 0").select("run_id", F.col("ts").alias("since"), F.col("event_id").alias("rate"))
    return asof.asof_join(events, marks, ["run_id"], "ts", "since", ["rate"]).drop("ts")
