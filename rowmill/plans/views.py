"""Messy inputs and log-shaped tables derived from the given tables, each with its SQL twin.

Only whole-number arithmetic and concatenation, so both engines produce the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators.runlog import STEPS, number_attempts
from rowmill.session import materialize
from rowmill.sources.tables import read_table

# Spellings and codes used by the derived inputs.
GIFT_WORDS = ("false", "N", "Y", "0", "true", "Yes", "NO", "f", "no", "yes", "FALSE", "N/A", "T", "1")
SYMBOLS = ("$", "€", "£", "¥", "₹")
CODES = ("USD", "EUR", "GBP", "JPY", "INR")
OFFSETS = ("Z", "+01:00", "-07:00", "+09:00")
STATUSES = (
    "completed", "completed", "completed", "failed", "cancelled", "reverted", "executing", "needs_clarification",
)


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _pick_sql(values, index: str) -> str:
    items = ", ".join("'" + v + "'" for v in values)
    return f"(list_value({items}))[CAST({index} AS INTEGER) + 1]"


def _text(c: Column) -> Column:
    return c.cast("string")


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    k, cust = F.col("o_orderkey"), _text(F.col("o_custkey"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, rest = _text(F.floor(cents / 100).cast("long")), F.lpad(_text(cents % 100), 2, "0")
    date = F.when(k % 9 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    clock = F.concat(F.lpad(_text(k % 24), 2, "0"), F.lit(":"), F.lpad(_text(k % 60), 2, "0"), F.lit(":00"))
    note = (
        F.when(k % 5 == 0, "")
        .when(k % 5 == 1, "N/A")
        .when(k % 5 == 2, "NULL")
        .when(k % 5 == 3, F.concat(F.lit("  note "), _text(k), F.lit("  ")))
        .otherwise(F.concat(F.lit("note "), _text(k)))
    )
    return o.select(
        k.alias("k"),
        F.col("o_custkey"),
        F.when(k % 97 == 0, "").otherwise(_text(k)).alias("id_s"),
        F.when(k % 2 == 0, F.concat(F.lit("User"), cust, F.lit("@Example.com")))
        .otherwise(F.concat(F.lit("user"), cust, F.lit("@example.com")))
        .alias("email"),
        date.alias("order_date_s"),
        F.concat(_pick(SYMBOLS, k % 5), whole, F.lit("."), rest).alias("amount_s"),
        _pick(CODES, k % 5).alias("currency"),
        F.when(k % 3 == 0, "").otherwise(F.concat(_text(k % 26), F.lit("%"))).alias("discount_s"),
        _pick(GIFT_WORDS, k % 14).alias("is_gift_s"),
        note.alias("notes"),
        F.when(k % 50 == 0, "12abc").otherwise(_text(k % 7)).alias("qty_s"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), clock, _pick(OFFSETS, k % 4)).alias(
            "created_at_s"
        ),
        F.concat(
            _text(k % 500), F.lit(" Main St, City "), _text(k % 20), F.lit(",  ST"), _text(k % 5)
        ).alias("address_s"),
        F.lit(None).cast("string").alias("empty_col"),
    )


DIRTY_ORDERS = f"""dirty_orders AS (
  SELECT o_orderkey AS k, o_custkey,
    CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS id_s,
    CASE WHEN o_orderkey % 2 = 0 THEN 'User' || CAST(o_custkey AS VARCHAR) || '@Example.com'
         ELSE 'user' || CAST(o_custkey AS VARCHAR) || '@example.com' END AS email,
    CASE WHEN o_orderkey % 9 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date_s,
    {_pick_sql(SYMBOLS, 'o_orderkey % 5')} || CAST(cents // 100 AS VARCHAR) || '.'
      || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS amount_s,
    {_pick_sql(CODES, 'o_orderkey % 5')} AS currency,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 26 AS VARCHAR) || '%' END AS discount_s,
    {_pick_sql(GIFT_WORDS, 'o_orderkey % 14')} AS is_gift_s,
    CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN 'NULL'
      WHEN 3 THEN '  note ' || CAST(o_orderkey AS VARCHAR) || '  '
      ELSE 'note ' || CAST(o_orderkey AS VARCHAR) END AS notes,
    CASE WHEN o_orderkey % 50 = 0 THEN '12abc' ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS qty_s,
    strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':'
      || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':00'
      || {_pick_sql(OFFSETS, 'o_orderkey % 4')} AS created_at_s,
    CAST(o_orderkey % 500 AS VARCHAR) || ' Main St, City ' || CAST(o_orderkey % 20 AS VARCHAR) || ',  ST'
      || CAST(o_orderkey % 5 AS VARCHAR) AS address_s,
    CAST(NULL AS VARCHAR) AS empty_col
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
)"""


def flat_sales(spark: SparkSession, folder: str) -> DataFrame:
    l = read_table(spark, folder, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"])
    c = read_table(spark, folder, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    p = read_table(spark, folder, "part", ["p_partkey", "p_name", "p_brand", "p_retailprice"])
    # Items meet only their part before they are joined to whole orders, so they are shuffled twice, and narrow the first time.
    sold = o.join(c, o.o_custkey == c.c_custkey)
    joined = l.join(p, l.l_partkey == p.p_partkey).join(sold, l.l_orderkey == o.o_orderkey)
    return joined.select(
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("order_priority"),
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("customer_segment"),
        F.col("c_acctbal").alias("customer_balance"),
        F.col("p_partkey").alias("part_id"),
        F.col("p_name").alias("part_name"),
        F.col("p_brand").alias("part_brand"),
        F.col("p_retailprice").alias("part_retail"),
    )


FLAT_SALES = """flat_sales AS (
  SELECT l_linenumber AS linenumber, l_quantity AS quantity, l_extendedprice AS price,
    o_orderkey AS order_id, o_orderdate AS order_date, o_orderstatus AS order_status,
    o_orderpriority AS order_priority, c_custkey AS customer_id, c_name AS customer_name,
    c_mktsegment AS customer_segment, c_acctbal AS customer_balance, p_partkey AS part_id, p_name AS part_name,
    p_brand AS part_brand, p_retailprice AS part_retail
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey
)"""


def flat_file(spark: SparkSession, folder: str) -> DataFrame:
    """The flat sales as a stored file, the form in which such data arrives."""
    return materialize(flat_sales(spark, folder), "flat")


def wide_items(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "part", ["p_partkey", "p_name", "p_brand", "p_size"])
    even = F.col("p_size") % 2 == 0
    return p.select(
        "p_partkey",
        F.col("p_name").alias("item_1_name"),
        F.col("p_size").alias("item_1_qty"),
        F.when(even, F.col("p_brand")).alias("item_2_name"),
        F.when(even, F.col("p_size") + 1).alias("item_2_qty"),
    )


def orphan_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey"])
    k = F.col("o_orderkey")
    shifted = F.when(k % 77 == 0, F.lit(None)).when(k % 100 == 0, F.col("o_custkey") + 1000000)
    return o.select("o_orderkey", F.when((k % 77 == 0) | (k % 100 == 0), shifted).otherwise(F.col("o_custkey")).alias("o_custkey"))


ORPHAN_ORDERS = """orphan_orders AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 77 = 0 THEN NULL WHEN o_orderkey % 100 = 0 THEN o_custkey + 1000000
    ELSE o_custkey END AS o_custkey FROM orders
)"""


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """One rate per currency and week, from the first order of the week on."""
    o = read_table(spark, folder, "orders", ["o_orderdate"])
    weeks = o.groupBy(F.date_trunc("week", "o_orderdate").alias("w")).agg(F.min("o_orderdate").alias("first"))
    each = weeks.select("first", F.posexplode(F.array(*[F.lit(c) for c in CODES])).alias("i", "currency"))
    day = F.date_add(F.to_date("first"), F.col("i"))
    number = F.datediff(day, F.lit("1970-01-01").cast("date"))
    return each.select("currency", day.alias("day"), (1 + (number * (F.col("i") + 3)) % 100 / 100).alias("rate"))


RATES = f"""rates AS (
  SELECT currency, day, 1 + (date_diff('day', DATE '1970-01-01', day) * (i + 3)) % 100 / 100 AS rate
  FROM (
    SELECT currency, i, CAST(first AS DATE) + CAST(i AS INTEGER) AS day
    FROM (SELECT date_trunc('week', o_orderdate) AS w, min(o_orderdate) AS first FROM orders GROUP BY 1),
      (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(CODES))}) AS codes(currency, i)
  )
)"""


def customer_v2(spark: SparkSession, folder: str) -> DataFrame:
    """Customers after a season: deep debtors gone, one segment respelled, suppliers added."""
    c = read_table(spark, folder, "customer")
    s = read_table(spark, folder, "supplier")
    segment = F.col("c_mktsegment")
    kept = c.filter("c_acctbal >= -900").withColumn(
        "c_mktsegment", F.when(segment == "BUILDING", F.lower(segment)).otherwise(segment)
    )
    new = s.select(
        (F.col("s_suppkey") + 1000000).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLY").alias("c_mktsegment"),
    )
    return kept.unionByName(new)


CUSTOMER_V2 = """customer_v2 AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal,
    CASE WHEN c_mktsegment = 'BUILDING' THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment
  FROM customer WHERE c_acctbal >= -900
  UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal, 'SUPPLY' FROM supplier
)"""


def projects(spark: SparkSession, folder: str) -> DataFrame:
    n = read_table(spark, folder, "nation", ["n_nationkey", "n_name"])
    return n.select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("project"))


def run_documents(spark: SparkSession, folder: str) -> DataFrame:
    c = read_table(spark, folder, "customer", ["c_custkey", "c_nationkey", "c_name"])
    return c.select(
        F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("document")
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One import run per order, in the project of its customer's nation."""
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    c = read_table(spark, folder, "customer", ["c_custkey", "c_nationkey"])
    k = F.col("o_orderkey")
    started = F.col("o_orderdate") + F.make_interval(hours=(k % 24).cast("int"))
    status = _pick(STATUSES, k % 8)
    finished = F.when(k % 11 == 0, F.lit(None)).otherwise(started + F.make_interval(days=(k % 3).cast("int")))
    return o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("run_id"),
        F.col("c_nationkey").alias("project_id"),
        F.col("o_custkey").alias("document_id"),
        status.alias("status"),
        started.alias("started_at"),
        finished.alias("finished_at"),
        F.when(status == "completed", F.concat(F.lit("v"), _text(k))).alias("snapshot"),
        (k % 13 == 0).alias("pinned"),
        (k % 4 == 0).alias("cancel_requested"),
        F.when(k % 5 == 0, "boom").alias("error_message"),
    )


RUNS = f"""runs AS (
  SELECT run_id, project_id, document_id, status, started_at,
    CASE WHEN run_id % 11 = 0 THEN NULL ELSE started_at + INTERVAL 1 DAY * CAST(run_id % 3 AS INTEGER) END AS finished_at,
    CASE WHEN status = 'completed' THEN 'v' || CAST(run_id AS VARCHAR) END AS snapshot,
    run_id % 13 = 0 AS pinned, run_id % 4 = 0 AS cancel_requested,
    CASE WHEN run_id % 5 = 0 THEN 'boom' END AS error_message
  FROM (
    SELECT o_orderkey AS run_id, c_nationkey AS project_id, o_custkey AS document_id,
      {_pick_sql(STATUSES, 'o_orderkey % 8')} AS status,
      o_orderdate + INTERVAL 1 HOUR * CAST(o_orderkey % 24 AS INTEGER) AS started_at
    FROM orders JOIN customer ON o_custkey = c_custkey
  )
)"""

STEP_ORDER = ["started_at", "l_partkey", "l_suppkey", "l_extendedprice"]


def raw_steps(spark: SparkSession, folder: str) -> DataFrame:
    """One step per order line, before attempts are numbered."""
    l = read_table(
        spark, folder, "lineitem",
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate", "l_quantity"],
    )
    step = _pick(STEPS, F.col("l_linenumber") % 5)
    return l.select(
        F.col("l_orderkey").alias("run_id"),
        step.alias("step"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("success").alias("status"),
        F.col("l_shipdate").alias("started_at"),
        (F.col("l_shipdate") + F.make_interval(secs=F.col("l_quantity"))).alias("finished_at"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


def steps(spark: SparkSession, folder: str) -> DataFrame:
    return number_attempts(raw_steps(spark, folder), STEP_ORDER).drop("l_partkey", "l_suppkey", "l_extendedprice")


RAW_STEPS = f"""raw_steps AS (
  SELECT l_orderkey AS run_id, {_pick_sql(STEPS, 'l_linenumber % 5')} AS step,
    CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'success' END AS status,
    l_shipdate AS started_at, l_shipdate + INTERVAL 1 SECOND * CAST(l_quantity AS INTEGER) AS finished_at,
    l_partkey, l_suppkey, l_extendedprice
  FROM lineitem
)"""
STEPS_SQL = f"""{RAW_STEPS}, steps AS (
  SELECT run_id, step, status, started_at, finished_at,
    row_number() OVER (PARTITION BY run_id, step ORDER BY started_at, l_partkey, l_suppkey, l_extendedprice) AS attempt
  FROM raw_steps
)"""


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events", ["event_id", "ts", "user_id", "event_type"])
    return e.select(
        F.col("user_id").alias("run_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("status"),
    )


RUN_EVENTS = """run_events AS (
  SELECT user_id AS run_id, event_id, ts, event_type AS status FROM events
)"""
