"""Registered structure and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators import catalog, digests, normalize, proposal, structure
from rowmill.plans import views as V
from rowmill.plans.importer import split_flat
from rowmill.plans.profiling import CUSTOMER, ORDERS, column_profile_sql, load_type_sql
from rowmill.plans.registry import query
from rowmill.sources.tables import read_table, read_tables

LINEITEM = [
    ("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"), ("l_quantity", "float"),
    ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "string"),
    ("l_linestatus", "string"), ("l_shipdate", "datetime"),
]
PART = [("p_partkey", "int"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "float")]
SUPPLIER = [("s_suppkey", "int"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "float")]
NATION = [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")]
REGION = [("r_regionkey", "int"), ("r_name", "string")]
SCHEMAS = {
    "customer": CUSTOMER, "orders": ORDERS, "lineitem": LINEITEM, "part": PART, "supplier": SUPPLIER, "nation": NATION, "region": REGION,
}


def _spread_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of the schema."""
    return read_tables(spark, folder, SCHEMAS)


_PROFILES = " UNION ALL ".join(column_profile_sql(t, c) for t, c in SCHEMAS.items())


@query(f"""SELECT region, column_name, row_count, distinct_count,
inferred_type IN ('int', 'string') AND null_rate = 0 AND distinct_count = row_count AS is_key FROM ({_PROFILES})""")
def candidate_keys(spark: SparkSession, folder: str) -> DataFrame:
    out = structure.candidate_keys(_spread_tables(spark, folder))
    return out.withColumnRenamed("column", "column_name")


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS distinct_values, max(n) AS largest_group, sum(n) / count(*) AS repetition,
    sum(n) >= 2 * count(*) AS repeated FROM (SELECT count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c})"""
    for c, _ in ORDERS))
def repeated_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    out = structure.repeated_identifiers(read_table(spark, folder, "orders"))
    return out.withColumnRenamed("column", "column_name")


def _dep_sql(key: str, attribute: str, source: str = "flat_sales") -> str:
    return f"""SELECT '{key}' AS key, '{attribute}' AS attribute, count(*) AS groups,
      count(*) FILTER (WHERE NOT (c = 0 OR (c = n AND lo = hi))) AS violations,
      count(*) FILTER (WHERE NOT (c = 0 OR (c = n AND lo = hi))) = 0 AS holds
      FROM (SELECT count(*) AS n, count({attribute}) AS c, min({attribute}) AS lo, max({attribute}) AS hi
        FROM {source} WHERE {key} IS NOT NULL GROUP BY {key})"""


_FD = [("customer_id", ["customer_name", "customer_segment", "customer_balance", "order_status"]),
       ("order_id", ["order_date", "customer_id", "part_id"]), ("part_brand", ["part_name"])]


@query(f"WITH {V.FLAT_SALES} " + " UNION ALL ".join(_dep_sql(k, a) for k, ats in _FD for a in ats))
def functional_deps(spark: SparkSession, folder: str) -> DataFrame:
    flat = V.flat_file(spark, folder)
    return structure.union_all([structure.functional_deps(flat, k, ats) for k, ats in _FD])


_CLUSTERS = {
    "order": ["order_id", "order_date", "order_status", "order_priority"],
    "customer": ["customer_id", "customer_name", "customer_segment", "customer_balance"],
    "part": ["part_id", "part_name", "part_brand", "part_retail"],
}


def _evidence_sql() -> str:
    parts = []
    for head, members in _CLUSTERS.items():
        widest = "greatest(" + ", ".join(f"(SELECT count(DISTINCT {m}) FROM flat_sales)" for m in members) + ")"
        for key in members:
            parts.append(
                f"""SELECT '{head}' AS cluster, '{key}' AS key, {len(members) - 1} AS attributes,
                count(*) AS row_count, count(DISTINCT {key}) AS distinct_values,
                count({key}) = count(*) AND count(*) >= 30 AND count(*) >= 2 * count(DISTINCT {key})
                  AND count(DISTINCT {key}) >= {widest} AS tested,
                (SELECT count(*) FROM (SELECT DISTINCT {", ".join(members)} FROM flat_sales)) AS c FROM flat_sales"""
            )
    return f"""SELECT cluster, key, attributes, row_count, distinct_values, tested, CASE WHEN tested THEN c ELSE 0 END AS combinations,
      tested AND c = distinct_values AS is_entity FROM ({" UNION ALL ".join(parts)})"""


@query(f"WITH {V.FLAT_SALES} {_evidence_sql()}")
def entity_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Prefix clusters of the flat sales with every member tried as the entity's key."""
    return structure.cluster_evidence(V.flat_file(spark, folder))


_ENUMS = [("o_orderstatus", "orders"), ("o_orderpriority", "orders")]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, max(length({c})) AS max_length,
    (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {t})) AS allowed FROM {t}
    HAVING count(DISTINCT {c}) <= 20 AND max(length({c})) <= 32""" for c, t in _ENUMS))
def enum_columns(spark: SparkSession, folder: str) -> DataFrame:
    return structure.enum_columns(read_table(spark, folder, "orders")).withColumnRenamed("column", "column_name")


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CASE WHEN count(*) < 30 OR count(DISTINCT {c}) * 2 > count({c}) THEN 'flat' ELSE 'split' END
    AS decision, CASE WHEN count(*) < 30 THEN 'small document' WHEN count(DISTINCT {c}) * 2 > count({c}) THEN 'no repetition'
    ELSE 'repeated entity' END AS reason FROM customer""" for c in ("c_custkey", "c_nationkey", "c_mktsegment", "c_name")))
def keep_flat(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["c_custkey", "c_nationkey", "c_mktsegment", "c_name"]
    return structure.keep_flat(read_table(spark, folder, "customer"), columns).withColumnRenamed("column", "column_name")


def _fk_sql() -> str:
    parts = []
    for ct, ccols in SCHEMAS.items():
        for pt, pcols in SCHEMAS.items():
            for c, ck in ccols:
                for p, pk in pcols:
                    same = ck == pk and ck in ("int", "string")
                    if ct != pt and same and structure.names_agree(ct, c, pt, p):
                        parts.append(
                            f"""SELECT '{ct}' AS child_table, '{c}' AS child_column, '{pt}' AS parent_table, '{p}' AS parent_column,
                            count(DISTINCT {c}) AS child_distinct,
                            count(DISTINCT {c}) FILTER (WHERE {c} IN (SELECT {p} FROM {pt})) AS matched,
                            round_even(count(DISTINCT {c}) FILTER (WHERE {c} IN (SELECT {p} FROM {pt})) / count(DISTINCT {c}), 4)
                              AS coverage,
                            count(DISTINCT {c}) FILTER (WHERE {c} IN (SELECT {p} FROM {pt})) = count(DISTINCT {c})
                              AND (SELECT count({p}) = count(DISTINCT {p}) FROM {pt}) AS is_fk FROM {ct}"""
                        )
    return " UNION ALL ".join(parts)


@query(_fk_sql())
def fk_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return structure.fk_candidates(_spread_tables(spark, folder))


def _proposal_sql(table: str, columns: list[tuple[str, str]], refs: dict[str, tuple[str, str]], source: str | None = None) -> str:
    """Proposal rows of one table; ``refs`` are the name-agreeing parents, kept where the data includes them."""
    src = source or table
    keyable = [c for c, k in columns if k in ("int", "string")]
    first_key = "CASE " + " ".join(
        f"WHEN (SELECT count(DISTINCT {c}) = count(*) FROM {src}) THEN '{c}'" for c in keyable
    ) + " ELSE '' END"
    out = []
    for i, ((c, _), kind) in enumerate(zip(columns, load_type_sql(columns), strict=True)):
        ref_table = ref_column = "CAST(NULL AS VARCHAR)"
        if c in refs:
            pt, pc = refs[c]
            ok = f"count({c}) = count(CASE WHEN {c} IN (SELECT {pc} FROM {pt}) THEN 1 END)"
            ref_table, ref_column = f"CASE WHEN {ok} THEN '{pt}' END", f"CASE WHEN {ok} THEN '{pc}' END"
        out.append(
            f"""SELECT '{table}' AS table_name, {i} AS pos, '{c}' AS column_name, {kind} AS type, count({c}) < count(*) AS nullable,
            ({first_key}) = '{c}' AS is_pk, {ref_table} AS ref_table, {ref_column} AS ref_column FROM {src}"""
        )
    return " UNION ALL ".join(out)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"column": "column_name", "table": "table_name"})


@query(" UNION ALL ".join([
    _proposal_sql("customer", CUSTOMER, {"c_nationkey": ("nation", "n_nationkey")}),
    _proposal_sql("nation", NATION, {}),
    _proposal_sql("orders", ORDERS, {"o_custkey": ("customer", "c_custkey")}),
]))
def proposal_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Types, gaps, keys and references of three tables, worked out from their rows."""
    return _named(proposal.propose(read_tables(spark, folder, ["customer", "nation", "orders"])))


@query(_proposal_sql("part", PART, {}))
def propose_single(spark: SparkSession, folder: str) -> DataFrame:
    """The proposal for one table alone, which has no references to find."""
    return _named(proposal.propose({"part": read_table(spark, folder, "part")}))


@query("""SELECT 'visits' AS child_table, 'house_id' AS child_column, 'houses' AS parent_table, 'id' AS parent_column,
count(DISTINCT s_nationkey) AS child_distinct, count(DISTINCT s_nationkey) AS matched, true AS is_fk FROM supplier
UNION ALL SELECT 'houses', 'series_id', 'series', 'id', count(DISTINCT n_regionkey), count(DISTINCT n_regionkey), true FROM nation
UNION ALL SELECT 'rentals', 'movie_id', 'movies', 'id', count(DISTINCT o_custkey), count(DISTINCT o_custkey), true FROM orders""")
def fk_irregular_plurals(spark: SparkSession, folder: str) -> DataFrame:
    """References to tables whose singular does not follow from an ending."""
    tables = {
        "houses": read_table(spark, folder, "nation").selectExpr("n_nationkey AS id", "n_regionkey AS series_id"),
        "series": read_table(spark, folder, "region").selectExpr("r_regionkey AS id"),
        "visits": read_table(spark, folder, "supplier").selectExpr("s_nationkey AS house_id"),
        "movies": read_table(spark, folder, "customer").selectExpr("c_custkey AS id"),
        "rentals": read_table(spark, folder, "orders").selectExpr("o_custkey AS movie_id"),
    }
    return structure.fk_candidates(tables).drop("coverage")


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 2 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal + 1 FROM supplier""")
def upsert_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Updates that name a key several times: the last one by their own number counts."""
    stored = read_table(spark, folder, "customer", ["c_custkey", "c_name", "c_acctbal"])
    twice = F.explode(F.array(F.lit(1), F.lit(2))).alias("turn")
    changed = stored.where("c_custkey % 3 = 0").select("c_custkey", "c_name", (F.col("c_acctbal")).alias("was"), twice)
    new = read_table(spark, folder, "supplier").selectExpr("s_suppkey + 1000000 AS c_custkey", "s_name AS c_name", "s_acctbal AS was", "1 AS turn")
    sent = changed.unionByName(new).select("c_custkey", "c_name", (F.col("was") + F.col("turn")).alias("c_acctbal"), "turn")
    return catalog.upsert(stored, sent, ["c_custkey"], latest=[F.col("turn")])


_CUSTOMER_NEXT = """next AS (SELECT c_custkey, CASE WHEN c_nationkey > 0 THEN c_name END AS c_name,
  CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS c_cents,
  c_mktsegment FROM customer_v2)"""
_NEXT = [("c_custkey", "int"), ("c_name", "string"), ("c_nationkey", "string"), ("c_cents", "int"), ("c_mktsegment", "string")]


@query(f"""WITH {V.CUSTOMER_V2}, {_CUSTOMER_NEXT}, a AS ({_proposal_sql("customer", CUSTOMER, {})}),
b AS ({_proposal_sql("customer", _NEXT, {}, "next")}),
d AS (SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.column_name, b.column_name) AS column_name,
  CASE WHEN a.column_name IS NULL THEN 'added' WHEN b.column_name IS NULL THEN 'dropped' WHEN a.type <> b.type THEN 'retyped'
  WHEN a.is_pk <> b.is_pk THEN 'rekeyed' WHEN a.nullable <> b.nullable THEN 'renullable' END AS change
  FROM a FULL JOIN b ON a.column_name = b.column_name)
SELECT * FROM d WHERE change IS NOT NULL""")
def schema_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Difference between the proposals for two states of the customer table."""
    before = read_table(spark, folder, "customer")
    after = V.customer_v2(spark, folder).select(
        "c_custkey",
        F.when(F.col("c_nationkey") > 0, F.col("c_name")).alias("c_name"),
        F.col("c_nationkey").cast("string").alias("c_nationkey"),
        F.round(F.col("c_acctbal") * 100).cast("long").alias("c_cents"),
        "c_mktsegment",
    )
    a = proposal.propose({"customer": before}, infer_foreign=False)
    b = proposal.propose({"customer": after}, infer_foreign=False)
    return _named(proposal.proposal_diff(a, b))


_TEXT_ORDERS = ["id_s", "qty_s", "currency", "empty_col"]


@query(f"""WITH {V.DIRTY_ORDERS}, approved AS (SELECT * FROM (VALUES ('id_s', 'integer'), ('qty_s', 'integer'), ('currency', 'text'),
('created_at_s', 'timestamptz')) AS v(c, t)),
loaded AS (SELECT 'id_s' AS c, CASE WHEN bool_and(id_s = '' OR regexp_full_match(id_s, '[0-9]+')) THEN 'integer' ELSE 'text' END AS t
  FROM dirty_orders UNION ALL SELECT 'qty_s', CASE WHEN bool_and(regexp_full_match(qty_s, '[0-9]+')) THEN 'integer' ELSE 'text' END
  FROM dirty_orders UNION ALL SELECT 'currency', max('text') FROM dirty_orders UNION ALL SELECT 'empty_col', max('text') FROM dirty_orders)
SELECT 'orders' AS table_name, coalesce(a.c, l.c) AS column_name, CASE WHEN a.c IS NULL THEN 'not approved'
  WHEN l.c IS NULL THEN 'missing' ELSE 'other type' END AS problem
FROM approved a FULL JOIN loaded l ON a.c = l.c WHERE a.c IS NULL OR l.c IS NULL OR a.t <> l.t""")
def load_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The types found in the dirty text against the approved columns."""
    from rowmill.operators.clean import clean_text
    from rowmill.operators.infer import infer_types

    approved = spark.createDataFrame(
        [("orders", "id_s", 0, "integer"), ("orders", "qty_s", 1, "integer"), ("orders", "currency", 2, "text"),
         ("orders", "created_at_s", 3, "timestamptz")],
        catalog.COLUMNS,
    )
    found = infer_types(clean_text(V.dirty_orders(spark, folder).select(*_TEXT_ORDERS)))
    loaded = found.select(F.lit("orders").alias("table"), "column", "pos", F.col("load_type").alias("type"))
    return _named(proposal.load_matches(approved, loaded))


def _reconcile_sql() -> str:
    tables = ("customer", "orders", "nation", "supplier")
    stored = " UNION ALL ".join(
        f"SELECT '{t}' AS e, '{c}' AS c, {k} AS t FROM {t}"
        for t in tables
        for (c, _), k in zip(SCHEMAS[t], load_type_sql(SCHEMAS[t]), strict=True)
    )
    columns = [("c_custkey", "int"), ("c_name", "string"), ("c_nationkey", "int")]
    incoming = " UNION ALL ".join(
        f"SELECT '{c}' AS c, {k} AS t FROM customer_v2" for (c, _), k in zip(columns, load_type_sql(columns), strict=True)
    )
    return f"""WITH {V.CUSTOMER_V2}, stored AS ({stored}), incoming AS ({incoming})
      SELECT 'incoming' AS incoming, e AS existing, count(*) AS shared, 3 AS incoming_columns,
        round_even(count(*) / 3, 4) AS coverage, count(*) = 3 AS compatible
      FROM incoming JOIN stored ON incoming.c = stored.c AND incoming.t = stored.t GROUP BY e"""


@query(_reconcile_sql())
def reconcile_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Which stored tables an incoming extract of customers fits, by the types its values need."""
    from rowmill.operators.infer import selected_load_types

    def columns(tables: dict[str, DataFrame]) -> DataFrame:
        return structure.union_all(
            [selected_load_types(df).select(F.lit(t).alias("table"), "column", F.col("load_type").alias("type"))
             for t, df in tables.items()]
        )

    stored = columns(read_tables(spark, folder, ["customer", "orders", "nation", "supplier"]))
    incoming = columns({"incoming": V.customer_v2(spark, folder).select("c_custkey", "c_name", "c_nationkey")})
    return structure.reconcile(incoming, stored)


@query(f"""WITH {V.FLAT_SALES} SELECT DISTINCT customer_id, customer_name, customer_segment, customer_balance FROM flat_sales""")
def extract_entity(spark: SparkSession, folder: str) -> DataFrame:
    flat = V.flat_sales(spark, folder)
    return normalize.extract_entity(flat, "customer_id", ["customer_name", "customer_segment", "customer_balance"])


@query(f"""WITH {V.FLAT_SALES} SELECT customer_segment, a.customer_id, a.customer_name FROM (
SELECT customer_segment, min(struct_pack(customer_id, customer_name)) AS a FROM flat_sales GROUP BY 1)""")
def extract_inconsistent(spark: SparkSession, folder: str) -> DataFrame:
    """Parent rows when the attributes do not depend on the key: smallest combination per key."""
    flat = V.flat_sales(spark, folder)
    return normalize.extract_entity(flat, "customer_segment", ["customer_id", "customer_name"], consistent=False)


@query(f"""WITH {V.FLAT_SALES}, segments AS (SELECT row_number() OVER (ORDER BY customer_segment) AS segment_id, customer_segment
FROM (SELECT DISTINCT customer_segment FROM flat_sales))
SELECT order_id, part_id, quantity, price, segment_id FROM flat_sales JOIN segments USING (customer_segment)""")
def child_with_fk(spark: SparkSession, folder: str) -> DataFrame:
    """Child rows with a text cluster replaced by the parent's new id."""
    flat = V.flat_sales(spark, folder)
    parent = normalize.surrogate_ids(
        normalize.extract_entity(flat, "customer_segment", []), ["customer_segment"], "segment_id"
    )
    child = flat.select("order_id", "part_id", "quantity", "price", "customer_segment")
    return normalize.fk_lookup(child, parent, "customer_segment", "segment_id", "segment_id")


@query("SELECT row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) AS id, o_custkey, o_orderkey FROM orders")
def surrogate_ids(spark: SparkSession, folder: str) -> DataFrame:
    df = read_table(spark, folder, "orders", ["o_custkey", "o_orderdate", "o_orderkey"])
    return normalize.surrogate_ids(df, ["o_custkey", "o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT p_partkey, 1 AS position, p_name AS name, p_size AS qty FROM part
UNION ALL SELECT p_partkey, 2, p_brand, p_size + 1 FROM part WHERE p_size % 2 = 0""")
def unpivot_groups(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.unpivot_groups(V.wide_items(spark, folder), ["p_partkey"])


@query(f"""WITH {V.FLAT_SALES} SELECT 'customers' AS table_name, count(DISTINCT customer_id) AS row_count FROM flat_sales
UNION ALL SELECT 'orders', count(DISTINCT order_id) FROM flat_sales
UNION ALL SELECT 'parts', count(DISTINCT part_id) FROM flat_sales
UNION ALL SELECT 'sales', count(*) FROM flat_sales""")
def split_flat_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence, choice of keys and split of the flat sales; rows per resulting table."""
    tables, _ = split_flat(V.flat_file(spark, folder), "sales")
    return catalog.row_counts(tables).withColumnRenamed("table", "table_name")


@query(f"""WITH {V.FLAT_SALES}, again AS (SELECT linenumber, quantity, price, s.order_id, order_date, order_status, order_priority,
s.customer_id, customer_name, customer_segment, customer_balance, s.part_id, part_name, part_brand, part_retail
FROM (SELECT linenumber, quantity, price, order_id, customer_id, part_id FROM flat_sales) s
JOIN (SELECT DISTINCT order_id, order_date, order_status, order_priority FROM flat_sales) o ON o.order_id = s.order_id
JOIN (SELECT DISTINCT customer_id, customer_name, customer_segment, customer_balance FROM flat_sales) c ON c.customer_id = s.customer_id
JOIN (SELECT DISTINCT part_id, part_name, part_brand, part_retail FROM flat_sales) p ON p.part_id = s.part_id)
SELECT (SELECT count(*) FROM (SELECT * FROM flat_sales EXCEPT ALL SELECT * FROM again))
 + (SELECT count(*) FROM (SELECT * FROM again EXCEPT ALL SELECT * FROM flat_sales)) AS differing_rows""")
def split_lossless(spark: SparkSession, folder: str) -> DataFrame:
    """Parents joined back to the child give the flat rows again, copies included."""
    flat = V.flat_file(spark, folder)
    keys = {"orders": "order_id", "customers": "customer_id", "parts": "part_id"}
    clusters = structure.prefix_clusters(flat.columns)
    parents, child = [], flat
    for head, members in clusters.items():
        key = keys[structure.table_name_for(head)]
        attributes = [m for m in members if m != key]
        parents.append((normalize.extract_entity(flat, key, attributes), key))
        child = normalize.child_with_key(child, attributes)
    again = normalize.rebuild(child, parents, flat.columns)
    lost = digests.differing_rows(flat, again)
    return lost.agg(F.count(F.lit(1)).alias("differing_rows"))
