"""Registered browsing and catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators import browse, catalog
from rowmill.plans import views as V
from rowmill.plans.registry import query
from rowmill.sources.tables import TABLES, read_table, read_tables

_ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders", _ORDER_COLUMNS.split(", "))


def _where(df: DataFrame, *filters: str, literal: bool = False) -> DataFrame:
    return df.filter(browse.predicate(df, filters, literal))


@query(f"""SELECT {_ORDER_COLUMNS} FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000.5 AND o_orderstatus <> 'F'
AND o_custkey > 100 AND o_orderkey <= 1000000 AND o_orderpriority = '1-URGENT'""")
def filter_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Every comparison operator, with literals in the column's type."""
    return _where(
        _orders(spark, folder), "o_totalprice:gte:100000", "o_totalprice:lt:200000.5", "o_orderstatus:neq:F",
        "o_custkey:gt:100", "o_orderkey:lte:1000000", "o_orderpriority:eq:1-URGENT",
    )


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-02-01'")
def filter_dates(spark: SparkSession, folder: str) -> DataFrame:
    df = read_table(spark, folder, "lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_shipdate"])
    return _where(df, "l_shipdate:gte:1998-01-01", "l_shipdate:lt:1998-02-01").drop("l_shipdate")


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%build%'
AND CAST(c_custkey AS VARCHAR) ILIKE '%1_%'""")
def filter_contains(spark: SparkSession, folder: str) -> DataFrame:
    """Case-insensitive substring on the text of any column; _ is a wildcard."""
    df = read_table(spark, folder, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    return _where(df, "c_mktsegment:contains:build", "c_custkey:contains:1_")


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'nation_1')")
def filter_contains_literal(spark: SparkSession, folder: str) -> DataFrame:
    return _where(read_table(spark, folder, "nation", ["n_nationkey", "n_name"]), "n_name:contains:NATION_1", literal=True)


@query(f"""WITH {V.ORPHAN_ORDERS} SELECT o_orderkey, o_custkey FROM orphan_orders WHERE o_custkey <> 5""")
def filter_null_never_matches(spark: SparkSession, folder: str) -> DataFrame:
    return _where(V.orphan_orders(spark, folder), "o_custkey:neq:5")


@query(f"""WITH {V.RUNS} SELECT run_id, status FROM runs WHERE status NOT IN ('completed', 'failed', 'cancelled', 'reverted')
AND snapshot IS NULL AND finished_at IS NOT NULL""")
def filter_membership(spark: SparkSession, folder: str) -> DataFrame:
    """Status outside a set, missing and present values."""
    from rowmill.operators.runlog import FINAL

    runs = V.runs(spark, folder)
    held = ~F.col("status").isin(*FINAL) & F.col("snapshot").isNull() & F.col("finished_at").isNotNull()
    return runs.filter(held).select("run_id", "status")


@query(f"""SELECT {_ORDER_COLUMNS} FROM orders WHERE o_orderpriority ILIKE '%urgent%'
ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 100 OFFSET 200""")
def sort_page_offset(spark: SparkSession, folder: str) -> DataFrame:
    page = browse.browse(
        _orders(spark, folder), ["o_orderkey"], ["o_orderpriority:contains:urgent"], "o_totalprice", "desc", cursor="200"
    )
    return page.rows


@query(f"""WITH {V.ORPHAN_ORDERS} SELECT o_orderkey, o_custkey FROM orphan_orders ORDER BY o_custkey DESC NULLS FIRST, o_orderkey LIMIT 500""")
def sort_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Descending sort puts NULL first, ties in key order."""
    return browse.browse(V.orphan_orders(spark, folder), ["o_orderkey"], sort="o_custkey", direction="desc", limit=500).rows


@query(f"""SELECT {_ORDER_COLUMNS} FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100""")
def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    return browse.browse(_orders(spark, folder), ["o_orderkey"], cursor=(500,)).rows


@query("""SELECT conv_id, turn, role FROM conversations WHERE conv_id > 20 OR (conv_id = 20 AND turn > 1)
ORDER BY conv_id, turn LIMIT 50""")
def keyset_page_composite(spark: SparkSession, folder: str) -> DataFrame:
    """Paging on a composite key keeps ties that cross the page edge."""
    df = read_table(spark, folder, "conversations", ["conv_id", "turn", "role"])
    return browse.browse(df, ["conv_id", "turn"], cursor=(20, 1), limit=50).rows


_WIDTH = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, {n} AS column_count FROM {t}" for t, n in _WIDTH.items()))
def catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.table_list(read_tables(spark, folder, TABLES)).withColumnRenamed("table", "table_name")


_RULES = {"customer": ["c_custkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"]}
_FOREIGN = [("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
_TYPES = {
    "customer": [("c_custkey", "bigint"), ("c_name", "text"), ("c_nationkey", "integer"), ("c_acctbal", "double precision"), ("c_mktsegment", "text")],
    "nation": [("n_nationkey", "integer"), ("n_name", "text"), ("n_regionkey", "integer")],
    "region": [("r_regionkey", "integer"), ("r_name", "text")],
}


def _catalog_sql() -> str:
    refs = {(t, c): (rt, rc) for t, c, rt, rc in _FOREIGN}
    out = []
    for t, cols in _TYPES.items():
        for i, (c, kind) in enumerate(cols):
            rt, rc = (f"'{v}'" for v in refs[(t, c)]) if (t, c) in refs else ("NULL", "NULL")
            pk = c in _RULES[t]
            out.append(
                f"""SELECT '{t}' AS table_name, {i} AS pos, '{c}' AS column_name, '{kind}' AS type, {not pk} AS nullable, {pk} AS is_pk,
                CAST({rt} AS VARCHAR) AS ref_table, CAST({rc} AS VARCHAR) AS ref_column, count(*) AS row_count, false AS editable FROM {t}"""
            )
    return " UNION ALL ".join(out)


@query(_catalog_sql())
def catalog_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-schema view: columns with keys, references and row counts."""
    rules = catalog.constraints(spark, _RULES, _FOREIGN)
    out = catalog.schema_view(spark, read_tables(spark, folder, _RULES), rules)
    return out.withColumnsRenamed({"table": "table_name", "column": "column_name"})


@query("""SELECT 'customer' AS src_table, 'c_nationkey' AS src_column, 'nation' AS dst_table, 'n_nationkey' AS dst_column
FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation) HAVING count(*) = (SELECT count(*) FROM customer)
UNION ALL SELECT 'supplier', 's_nationkey', 'nation', 'n_nationkey'
FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation) HAVING count(*) = (SELECT count(*) FROM supplier)""")
def fk_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Reference edges of the proposed schema."""
    from rowmill.operators.proposal import propose

    p = propose(read_tables(spark, folder, ["customer", "supplier", "nation"])).filter("ref_table IS NOT NULL")
    rules = p.select("table", "column", "pos", F.lit("fk").alias("kind"), "ref_table", "ref_column")
    return catalog.fk_edges(rules)


@query("""WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT c_mktsegment, count(*) AS customers FROM customer JOIN big ON c_custkey = o_custkey WHERE total > 1000000 GROUP BY 1""")
def read_query(spark: SparkSession, folder: str) -> DataFrame:
    """A read-only statement over stored tables."""
    for name in ("orders", "customer"):
        read_table(spark, folder, name).createOrReplaceTempView(f"read_{name}")
    return browse.read_frame(
        spark,
        """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM read_orders GROUP BY 1)
        SELECT c_mktsegment, count(*) AS customers FROM read_customer JOIN big ON c_custkey = o_custkey
        WHERE total > 1000000 GROUP BY 1""",
    )
