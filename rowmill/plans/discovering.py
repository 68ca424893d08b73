"""Registered queries that find structure without the help of names."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators import catalog, dependencies, digests, references
from rowmill.operators.profile import column_facts, long_cells
from rowmill.operators.structure import inclusion, names_agree
from rowmill.plans import views as V
from rowmill.plans.registry import query
from rowmill.session import materialize
from rowmill.sources.tables import read_table

# The flat sales under names that share no prefix and look like no identifier.
BARE = {
    "linenumber": "linenumber", "quantity": "quantity", "price": "price", "order_id": "ordered", "order_date": "day",
    "order_status": "state", "order_priority": "urgency", "customer_id": "client", "customer_name": "caller",
    "customer_segment": "segment", "customer_balance": "balance", "part_id": "article", "part_name": "label",
    "part_brand": "brand", "part_retail": "retail",
}
_NAMES = list(BARE.values())
_ABLE = ["linenumber", "ordered", "state", "urgency", "client", "caller", "segment", "article", "label", "brand"]
_WHOLE = {"linenumber", "ordered", "client", "article"}
BARE_SALES = f"{V.FLAT_SALES}, bare AS (SELECT {', '.join(f'{a} AS {b}' for a, b in BARE.items())} FROM flat_sales)"


def bare_sales(spark: SparkSession, folder: str) -> DataFrame:
    return V.flat_sales(spark, folder).withColumnsRenamed(BARE)


def _groups_sql(x: tuple[str, ...]) -> str:
    """Groups of a determinant, and in how many of them each column has two values."""
    cells = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _NAMES)
    bad = ", ".join(f"count(*) FILTER (lo_{c} <> hi_{c})" for c in _NAMES)
    key = ", ".join(f"'{c}'" for c in x)
    return f"SELECT [{key}] AS x, count(*) AS g, [{bad}] AS bad FROM (SELECT {cells} FROM bare GROUP BY {', '.join(x)})"


_ALL = [(c,) for c in _ABLE] + list(combinations(_ABLE, 2))

# All pairs (and triples) of determinant and column, then the same cover: smallest table first, no column twice.
_ENTITIES = f"""WITH {BARE_SALES},
groups AS MATERIALIZED ({" UNION ALL ".join(_groups_sql(x) for x in _ALL)}),
names AS (SELECT unnest({_NAMES}) AS y, unnest(range({len(_NAMES)})) AS place),
n AS (SELECT count(*) AS n FROM bare),
d AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS d FROM bare" for c in _NAMES)}),
able AS (SELECT c FROM d, n WHERE c IN {tuple(_ABLE)} AND d > 1 AND 2 * d <= n),
fds AS (
  SELECT x, g, y, place FROM (SELECT x, g, unnest(bad) AS b, unnest({_NAMES}) AS y, unnest(range({len(_NAMES)})) AS place FROM groups)
  JOIN d ON d.c = y, n
  WHERE b = 0 AND NOT list_contains(x, y) AND 2 * g <= n AND d > 1 AND 2 * d <= n AND list_has_all((SELECT list(c) FROM able), x)
),
one AS (SELECT x[1] AS x, g, y FROM fds WHERE len(x) = 1),
rep AS (
  SELECT DISTINCT x, g FROM one a WHERE NOT EXISTS (
    SELECT 1 FROM one b JOIN one c ON b.x = c.y AND b.y = c.x JOIN names p ON p.y = b.y JOIN names q ON q.y = a.x
    WHERE b.x = a.x AND (b.y NOT IN {tuple(sorted(_WHOLE))}, p.place) < (a.x NOT IN {tuple(sorted(_WHOLE))}, q.place))
),
two AS (
  SELECT x, g, y FROM fds f WHERE len(x) = 2
    AND NOT EXISTS (SELECT 1 FROM one WHERE one.x IN (f.x[1], f.x[2]) AND one.y IN (f.x[1], f.x[2]))
    AND NOT EXISTS (SELECT 1 FROM one WHERE one.y = f.y)
    AND NOT EXISTS (
      SELECT 1 FROM one b JOIN one c ON b.x = c.y AND b.y = c.x JOIN names p ON p.y = b.y JOIN names q ON q.y = b.x
      WHERE b.x IN (f.x[1], f.x[2]) AND (b.y NOT IN {tuple(sorted(_WHOLE))}, p.place) < (b.x NOT IN {tuple(sorted(_WHOLE))}, q.place))
),
owners AS (SELECT [x] AS x, g, y FROM one JOIN rep USING (x, g) UNION ALL SELECT x, g, y FROM two),
placed AS (
  SELECT o.x, o.g, o.y, names.place FROM owners o JOIN names USING (y) JOIN names k ON k.y = o.x[1]
  QUALIFY row_number() OVER (PARTITION BY o.y ORDER BY len(o.x), g, k.place, o.x) = 1
)
SELECT array_to_string(x, ', ') AS key, string_agg(y, ', ' ORDER BY place) AS attributes, g AS row_count FROM placed GROUP BY x, g"""


@query(_ENTITIES)
def discovered_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of the flat sales found by dependencies alone, determinants of one and two columns."""
    return dependencies.entity_rows(materialize(bare_sales(spark, folder), "bare"))


_SPLIT = {"ordereds": ("ordered", "day", "state", "urgency", "client"), "clients": ("client", "caller", "segment", "balance"),
          "articles": ("article", "label", "brand", "retail")}


@query(f"""WITH {BARE_SALES}, again AS (
SELECT {', '.join(_NAMES)} FROM (SELECT linenumber, quantity, price, ordered, article FROM bare)
{' '.join(f"JOIN (SELECT DISTINCT {', '.join(c)} FROM bare) {t} USING ({c[0]})" for t, c in _SPLIT.items())})
SELECT (SELECT count(*) FROM (SELECT * FROM bare EXCEPT ALL SELECT * FROM again))
 + (SELECT count(*) FROM (SELECT * FROM again EXCEPT ALL SELECT * FROM bare)) AS differing_rows,
(SELECT count(DISTINCT ordered) + count(DISTINCT client) + count(DISTINCT article) + count(*) FROM bare) AS stored_rows,
'articles.article, clients.client, ordereds.ordered' AS parents""")
def split_discovered(spark: SparkSession, folder: str) -> DataFrame:
    """The tables found are stored rows less often and join back to the flat rows."""
    flat = materialize(bare_sales(spark, folder), "bare")
    tables, keys = dependencies.split_entities(flat, "sales")
    again = dependencies.joined_back(tables, "sales", keys)
    lost = digests.differing_rows(flat, again).agg(F.count(F.lit(1)).alias("differing_rows"))
    stored = catalog.row_counts(tables).agg(F.sum("row_count").cast("bigint").alias("stored_rows"))
    parents = ", ".join(sorted({f"{p}.{k}" for _, _, p, k in dependencies.references(tables, keys)}))
    return lost.select("differing_rows", stored.scalar().alias("stored_rows"), F.lit(parents).alias("parents"))


# The tables under names that tell nothing of each other; whole numbers first, then texts.
RENAMED = {
    "customer": ({"c_custkey": "client", "c_nationkey": "land"}, {"c_name": "title", "c_mktsegment": "branch"}),
    "orders": ({"o_orderkey": "purchase", "o_custkey": "buyer"}, {"o_orderstatus": "state", "o_orderpriority": "urgency"}),
    "lineitem": (
        {"l_orderkey": "belongs", "l_partkey": "article", "l_suppkey": "origin", "l_linenumber": "line"},
        {"l_returnflag": "back", "l_linestatus": "progress"},
    ),
    "part": ({"p_partkey": "thing", "p_size": "extent"}, {"p_name": "wording", "p_brand": "make", "p_type": "sort"}),
    "supplier": ({"s_suppkey": "vendor", "s_nationkey": "seat"}, {"s_name": "firm"}),
    "nation": ({"n_nationkey": "country", "n_regionkey": "continent"}, {"n_name": "called"}),
    "region": ({"r_regionkey": "zone"}, {"r_name": "known"}),
}


def renamed_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, folder, t, [*a, *b]).withColumnsRenamed(a | b) for t, (a, b) in RENAMED.items()}


def _pairs_sql() -> str:
    """Every pair of one kind in different tables, with its counts."""
    columns = [(t, old, new, kind) for t, kinds in RENAMED.items() for kind, names in enumerate(kinds) for old, new in names.items()]
    values = ", ".join(f"u_{new} AS MATERIALIZED (SELECT DISTINCT {old} AS v FROM {t} WHERE {old} IS NOT NULL)" for t, old, new, _ in columns)
    pairs = " UNION ALL ".join(
        f"""SELECT '{t}' AS child_table, '{c}' AS child_column, '{p}' AS parent_table, '{k}' AS parent_column,
        (SELECT count(*) FROM u_{c}) AS child_distinct, (SELECT count(*) FROM u_{k}) AS parent_distinct,
        (SELECT count({old}) FROM {p}) AS filled, (SELECT count(*) FROM (SELECT v FROM u_{c} EXCEPT SELECT v FROM u_{k})) AS missing,
        {str(names_agree(t, c, p, k)).upper()} AS same_name"""
        for t, _, c, kind in columns for p, old, k, other in columns if t != p and kind == other
    )
    return f"""WITH {values}, pairs AS ({pairs}),
      possible AS (SELECT * FROM pairs WHERE parent_distinct = filled AND parent_distinct > 0 AND child_distinct > 0),
      found AS (SELECT child_table, child_column, parent_table, parent_column, child_distinct, parent_distinct,
        round_even(child_distinct / parent_distinct, 4) AS parent_coverage, same_name FROM possible WHERE missing = 0)"""


@query(f"{_pairs_sql()} SELECT * FROM found")
def fk_by_value(spark: SparkSession, folder: str) -> DataFrame:
    """Foreign keys between tables whose column names say nothing: all that the values allow."""
    return references.foreign_keys_by_value(renamed_tables(spark, folder))[0]


@query(f"""{_pairs_sql()} SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY child_table, child_column
ORDER BY same_name DESC, parent_coverage DESC, parent_table, parent_column) AS n FROM found) WHERE n = 1""")
def fk_best_parents(spark: SparkSession, folder: str) -> DataFrame:
    """The likeliest parent of each column."""
    return references.best_parents(references.foreign_keys_by_value(renamed_tables(spark, folder))[0])


@query(f"""{_pairs_sql()} SELECT (SELECT count(*) FROM possible) AS pairs, (SELECT count(*) FROM found) AS confirmed,
0::BIGINT AS missed, TRUE AS narrowing""")
def fk_pruning_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the pairs that hold the pruning lost, by an exact test of all pairs."""
    tables = renamed_tables(spark, folder)
    found, stats = references.foreign_keys_by_value(tables, sketch_size=64)
    facts = {(r["region"], r["column"]): r for r in column_facts(tables).collect()}
    ids, cells = long_cells(tables)
    kinds = {(t, c): kind for t, names in RENAMED.items() for kind, columns in enumerate(names) for c in columns.values()}
    number = {c: i for i, c in enumerate(ids)}
    pairs = [
        (c, p, number[c], number[p])
        for p, f in facts.items() if f["distinct_values"] == f["row_count"] - f["null_count"] > 0
        for c in ids if c[0] != p[0] and kinds[c] == kinds[p] and facts[c]["distinct_values"] > 0
    ]
    exact = inclusion(cells, pairs).where("child_distinct > 0 AND matched = child_distinct")
    keys = ["child_table", "child_column", "parent_table", "parent_column"]
    missed = exact.join(found, keys, "left_anti").agg(F.count(F.lit(1)).alias("missed"))
    narrowing = stats.pairs >= stats.by_count >= stats.by_sketch >= stats.confirmed and stats.by_sketch < stats.by_count
    return missed.select(
        F.lit(stats.pairs).cast("bigint").alias("pairs"), F.lit(stats.confirmed).cast("bigint").alias("confirmed"), "missed",
        F.lit(narrowing).alias("narrowing"),
    )
