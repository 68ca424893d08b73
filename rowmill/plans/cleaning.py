"""Registered cleaning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions import convert as C
from rowmill.functions import names
from rowmill.operators import clean
from rowmill.plans import views as V
from rowmill.plans.registry import query
from rowmill.sources.tables import read_table

_BLANK = "nullif(trim({c}), '')"
_CLEAN = "CASE WHEN upper(trim({c})) IN ('N/A', 'NULL') THEN NULL ELSE nullif(trim({c}), '') END"
_DATE = ("coalesce(CAST(try_strptime(order_date_s, '%Y-%m-%d') AS DATE), "
         "CAST(try_strptime(order_date_s, '%m/%d/%Y') AS DATE))")


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, {_CLEAN.format(c='id_s')} AS id_s, {_CLEAN.format(c='discount_s')} AS discount_s,
{_CLEAN.format(c='is_gift_s')} AS is_gift_s, {_CLEAN.format(c='notes')} AS notes,
{_CLEAN.format(c='address_s')} AS address_s FROM dirty_orders""")
def clean_nulls(spark: SparkSession, folder: str) -> DataFrame:
    df = V.dirty_orders(spark, folder).select("k", "id_s", "discount_s", "is_gift_s", "notes", "address_s")
    return clean.clean_text(df)


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, strftime({_DATE}, '%Y-%m-%d') AS order_date FROM dirty_orders""")
def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    df = V.dirty_orders(spark, folder)
    return df.select("k", F.date_format(C.to_date(F.col("order_date_s")), "yyyy-MM-dd").alias("order_date"))


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, epoch_us(CAST(created_at_s AS TIMESTAMPTZ)) AS created_us FROM dirty_orders""")
def parse_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    """Offset timestamps as instants."""
    df = V.dirty_orders(spark, folder)
    return df.select("k", F.unix_micros(C.to_timestamp(F.col("created_at_s"))).alias("created_us"))


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, CASE WHEN lower(is_gift_s) IN ('y','yes','t','true','1') THEN true
WHEN lower(is_gift_s) IN ('n','no','f','false','0') THEN false END AS is_gift FROM dirty_orders""")
def parse_booleans(spark: SparkSession, folder: str) -> DataFrame:
    df = V.dirty_orders(spark, folder)
    return df.select("k", C.to_boolean(F.col("is_gift_s")).alias("is_gift"))


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, CAST(CAST(substr(amount_s, 2) AS DECIMAL(18,2)) AS DOUBLE) AS amount,
substr(amount_s, 1, 1) AS symbol, true AS code_ok FROM dirty_orders""")
def parse_amounts(spark: SparkSession, folder: str) -> DataFrame:
    df = V.dirty_orders(spark, folder)
    amount = F.col("amount_s")
    return df.select(
        "k",
        C.to_amount(amount).cast("double").alias("amount"),
        C.amount_symbol(amount).alias("symbol"),
        C.symbol_fits_code(amount, F.col("currency")).alias("code_ok"),
    )


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, CAST(try_cast(rtrim(discount_s, '%') AS INTEGER) AS DOUBLE) / 100 AS discount
FROM dirty_orders""")
def parse_percents(spark: SparkSession, folder: str) -> DataFrame:
    df = V.dirty_orders(spark, folder)
    return df.select("k", C.to_percent(F.col("discount_s")).cast("double").alias("discount"))


@query(f"""WITH {V.DIRTY_ORDERS}
SELECT k, 'qty_s' AS column_name, qty_s AS value, 'int' AS target FROM dirty_orders WHERE NOT regexp_full_match(qty_s, '[0-9]+')
UNION ALL SELECT k, 'is_gift_s', is_gift_s, 'to_boolean' FROM dirty_orders WHERE is_gift_s = 'N/A'""")
def cast_rejects(spark: SparkSession, folder: str) -> DataFrame:
    df = V.dirty_orders(spark, folder)
    out = clean.cast_rejects(df, ["k"], {"qty_s": "int", "is_gift_s": C.to_boolean})
    return out.withColumnRenamed("column", "column_name")


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, coalesce(try_cast(qty_s AS INTEGER), -1) AS qty FROM dirty_orders""")
def try_casts(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that stay after a cast with rejects; lost cells then get a constant."""
    df = clean.try_convert(V.dirty_orders(spark, folder).select("k", F.col("qty_s").alias("qty")), {"qty": "int"})
    return clean.fill_missing(df, {"qty": -1})


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, lower(email) AS email, trim(notes) AS notes FROM dirty_orders""")
def trim_case(spark: SparkSession, folder: str) -> DataFrame:
    df = V.dirty_orders(spark, folder)
    return df.select("k", F.lower("email").alias("email"), C.trimmed(F.col("notes")).alias("notes"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedupe_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """The newest order of each customer."""
    df = read_table(spark, folder, "orders", ["o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"])
    return clean.dedupe_by_key(df, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).drop("o_orderdate")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def dedupe_rows(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_exact_duplicates(read_table(spark, folder, "customer", ["c_nationkey", "c_mktsegment"]))


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, coalesce({_BLANK.format(c='discount_s')}, '0%') AS discount_s,
coalesce(empty_col, 'unknown') AS empty_col FROM dirty_orders""")
def fill_missing(spark: SparkSession, folder: str) -> DataFrame:
    df = clean.clean_text(V.dirty_orders(spark, folder).select("k", "discount_s", "empty_col"))
    return clean.fill_missing(df, {"discount_s": "0%", "empty_col": "unknown"})


@query("""SELECT c_custkey AS customer_id, c_name || ' ' || c_mktsegment AS label,
CAST(round(c_acctbal * 100) AS BIGINT) AS balance_cents FROM customer""")
def derive_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Joined text, rescaled money, agreed names."""
    df = read_table(spark, folder, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    out = df.select(
        "c_custkey",
        C.joined(F.col("c_name"), F.col("c_mktsegment")).alias("label"),
        C.rescale(F.col("c_acctbal")).alias("balance_cents"),
    )
    return clean.rename(out, {"c_custkey": "customer_id"})


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, trim(split_part(address_s, ',', 1)) AS street,
trim(split_part(address_s, ',', 2)) AS city, trim(split_part(address_s, ',', 3)) AS state FROM dirty_orders""")
def split_composite(spark: SparkSession, folder: str) -> DataFrame:
    a = F.col("address_s")
    return V.dirty_orders(spark, folder).select(
        "k", C.part_of(a, 0).alias("street"), C.part_of(a, 1).alias("city"), C.part_of(a, 2).alias("state")
    )


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, 'id_s' AS column_name FROM dirty_orders WHERE id_s = ''
UNION ALL SELECT k, 'empty_col' FROM dirty_orders""")
def required_values(spark: SparkSession, folder: str) -> DataFrame:
    """Quarantine of missing values in required columns."""
    df = clean.clean_text(V.dirty_orders(spark, folder).select("k", "id_s", "empty_col"))
    return clean.missing_required(df, ["k"], ["id_s", "empty_col"]).withColumnRenamed("column", "column_name")


@query(f"""WITH {V.DIRTY_ORDERS} SELECT count(*) FILTER (WHERE id_s <> '') AS kept,
count(*) FILTER (WHERE id_s = '') AS dropped FROM dirty_orders""")
def skip_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    df = clean.clean_text(V.dirty_orders(spark, folder).select("id_s"))
    kept, counts = clean.skip_null_keys(df, ["id_s"])
    del kept
    return counts


@query(f"""WITH {V.DIRTY_ORDERS} SELECT id_s, o_custkey FROM dirty_orders WHERE id_s <> ''""")
def rows_with_keys(spark: SparkSession, folder: str) -> DataFrame:
    df = clean.clean_text(V.dirty_orders(spark, folder).select("id_s", "o_custkey"))
    return clean.skip_null_keys(df, ["id_s"])[0]


@query(f"""WITH {V.DIRTY_ORDERS} SELECT k, CAST(CAST(substr(amount_s, 2) AS DECIMAL(18,2)) AS DOUBLE) AS amount,
strftime({_DATE}, '%Y-%m-%d') AS day FROM dirty_orders""")
def strict_cast(spark: SparkSession, folder: str) -> DataFrame:
    """Inferred types applied strictly: nothing is lost, or the job stops."""
    from rowmill.operators.infer import apply_types

    df = V.dirty_orders(spark, folder)
    texts = df.select(
        F.col("k"),
        C.to_amount(F.col("amount_s")).cast("string").alias("amount"),
        C.to_date(F.col("order_date_s")).cast("string").alias("day"),
    )
    out = apply_types(texts, {"amount": "double precision", "day": "date"})
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, user_id, value FROM events""")
def render_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells for display: numbers stay, times become text."""
    from rowmill.operators.browse import render

    df = read_table(spark, folder, "events", ["event_id", "ts", "user_id", "value"])
    return render(df.withColumn("at", F.date_trunc("second", "ts")).drop("ts"))


@query("""SELECT n_nationkey, substr(trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_'), 1, 32) AS slug FROM nation""")
def name_slugs(spark: SparkSession, folder: str) -> DataFrame:
    df = read_table(spark, folder, "nation", ["n_nationkey", "n_name"])
    return df.select("n_nationkey", names.slug(F.col("n_name")).alias("slug"))
