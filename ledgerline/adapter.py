"""Test-data adapter: the star-schema tables stand in for the three raw
retail tables (products, customers, orders).

The same mapping is written twice: once as DataFrame code (``raw_tables``)
and once as SQL CTEs (``ORACLE_CTES``) for the DuckDB oracle.  Keep the
two in step.

Mapping (fixed choices of this adapter):
  orders    = lineitem JOIN orders, order region via supplier -> nation -> region
  order_id  = l_orderkey, product_id = l_partkey, customer_id = o_custkey
  order_date = o_orderdate, quantity = l_quantity,
  total_amount = l_extendedprice, price = l_extendedprice / l_quantity
  discount_pct = l_discount * 100, promotion_flag = (l_discount > 0)
  channel = o_orderpriority, payment_method = o_orderstatus,
  shipping_status = l_linestatus, anomaly_flag = (l_returnflag = 'R')
  products  = part (p_type is the category, p_retailprice the base price)
  customers = customer JOIN nation JOIN region (segment = c_mktsegment)
  margin_pct = p_size / 2, popularity_score = p_partkey % 100 / 4,
  purchase_frequency = c_custkey % 13, age = 18 + c_custkey % 60,
  discount_sensitivity = c_custkey % 11 / 8 (exact in binary, so that sums
  do not depend on the order of the rows)
Row order of the order table (used for pandas-style ``first``) is the
lexicographic order of ``line_key``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table_path


@dataclass
class RawTables:
    products: DataFrame
    customers: DataFrame
    orders: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


# Total order of order lines: ``(l_orderkey, l_linenumber)`` alone is not unique
# in the test data, so all identifying columns take part.  With them, the column
# of the order table that holds the same value (or the name it has beside them).
LINE_KEY = {"l_orderkey": "order_id", "l_linenumber": "__line_number", "l_partkey": "product_id",
            "l_suppkey": "__supplier_id", "l_quantity": "quantity", "l_extendedprice": "total_amount",
            "l_shipdate": "__ship_date"}


def line_key_col(side: str | None = None):
    """The key of a line; with ``side`` (a prefix of names) from an order table whose key is taken apart."""
    return F.struct(*(F.col(raw if side is None else side + own).alias(f"k{i}")
                      for i, (raw, own) in enumerate(LINE_KEY.items(), 1)))


def unit_price_col(amount: str, quantity: str):
    """The price of a line's piece; null where the quantity is zero."""
    return F.when(F.col(quantity) != 0, F.col(amount) / F.col(quantity))


def nation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation key -> nation and region name; both tables are fixed (25 and 5
    rows), so broadcasting them is bounded."""
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


# names that the customers' columns have beside the order table's own
CUSTOMER_SIDE = "__customer_"


def orders_table(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None, named: bool = True) -> DataFrame:
    """The order table, one row per line.

    ``customers`` (with ``customer_id``) are left-joined by the way, their columns
    named ``CUSTOMER_SIDE`` + name: they meet the orders before the lines do, so
    no shuffle by customer moves a line.  ``line_key`` is then taken apart
    (``LINE_KEY``), for most of it stands in other columns of the line.  Of a
    supplier only its nation's key goes through the join, whose size the planner
    can tell; unless ``named``, it stands for ``region``, for ``nation_regions``.
    """
    li = read(spark, sf_dir, "lineitem")
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    more = [line_key_col().alias("line_key")]
    if customers is not None:
        c = customers.select(*(F.col(f"`{name}`").alias(CUSTOMER_SIDE + name) for name in customers.columns))
        o = o.join(c, o.o_custkey == c[f"{CUSTOMER_SIDE}customer_id"], "left")
        more = [*(F.col(raw).alias(own) for raw, own in LINE_KEY.items() if own.startswith("__")), *c.columns]
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("region"))
    j = li.join(s, li.l_suppkey == s.s_suppkey, "left")
    if named:
        nr = nation_regions(spark, sf_dir)
        j = j.join(F.broadcast(nr), j.region == nr.n_nationkey, "left").drop("region").withColumnRenamed("r_name", "region")
    j = j.withColumn("l_returnflag", (F.col("l_returnflag") == "R").cast("int")).join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("l_quantity").alias("quantity"),
        unit_price_col("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_extendedprice").alias("total_amount"),
        (F.col("l_discount") * F.lit(100.0)).alias("discount_pct"),
        (F.col("l_discount") > 0).cast("int").alias("promotion_flag"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_orderstatus").alias("payment_method"),
        F.col("l_linestatus").alias("shipping_status"),
        F.col("region"),
        F.col("l_returnflag").alias("anomaly_flag"),
        *more,
    )


def products_table(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The catalogue.

    ``spread`` deals the short rows of the table to all cores first, for work on
    the long texts: a table of few megabytes is read by one or few tasks.
    """
    p = read(spark, sf_dir, "part")
    if spread:
        p = p.select("p_partkey", "p_name", "p_type", "p_brand", "p_retailprice", "p_size").repartition(
            4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("base_price"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("size"),
        F.rtrim(F.repeat(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.lit("")),
                         F.lit(12) + F.col("p_size").cast("int") % 9)).alias("product_description"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("returns within "), F.col("p_size").cast("string"),
                                                     F.lit(" days"))).alias("return_policy"),
        (F.col("p_size") * F.lit(0.5)).alias("margin_pct"),
        (F.col("p_partkey") % 100 * F.lit(0.25)).alias("popularity_score"),
    )


def customers_table(spark: SparkSession, sf_dir: str, named: bool = True) -> DataFrame:
    """The customers; unless ``named``, the key of their nation stands for ``location``
    and ``region``, for ``nation_regions``."""
    c = read(spark, sf_dir, "customer")
    if named:
        nr = nation_regions(spark, sf_dir)
        j = c.join(F.broadcast(nr), c.c_nationkey == nr.n_nationkey, "left")
    else:
        j = c.withColumns({"n_name": F.col("c_nationkey"), "r_name": F.col("c_nationkey")})
    return j.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("n_name").alias("location"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("segment"),
        (F.col("c_custkey") % 13 * F.lit(1.0)).alias("purchase_frequency"),
        (F.col("c_custkey") % 60 + F.lit(18.0)).alias("age"),
        (F.col("c_custkey") % 11 * F.lit(0.125)).alias("discount_sensitivity"),
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    return RawTables(products_table(spark, sf_dir), customers_table(spark, sf_dir),
                     orders_table(spark, sf_dir))


# ---------------------------------------------------------------------------
# The same adapter as SQL (DuckDB dialect) for the oracle.
ORACLE_CTES = """
orders_c AS (
  SELECT l.l_orderkey AS order_id, l.l_partkey AS product_id, o.o_custkey AS customer_id,
         o.o_orderdate AS order_date, l.l_quantity AS quantity,
         CASE WHEN l.l_quantity <> 0 THEN l.l_extendedprice / l.l_quantity END AS price,
         l.l_extendedprice AS total_amount, l.l_discount * 100.0 AS discount_pct,
         CAST(l.l_discount > 0 AS INTEGER) AS promotion_flag,
         o.o_orderpriority AS channel, o.o_orderstatus AS payment_method,
         l.l_linestatus AS shipping_status, sr.r_name AS region,
         CAST(l.l_returnflag = 'R' AS INTEGER) AS anomaly_flag,
         {'k1': l.l_orderkey, 'k2': l.l_linenumber, 'k3': l.l_partkey, 'k4': l.l_suppkey,
          'k5': l.l_quantity, 'k6': l.l_extendedprice, 'k7': l.l_shipdate} AS line_key
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN (SELECT s.s_suppkey, r.r_name FROM supplier s
             LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
             LEFT JOIN region r ON n.n_regionkey = r.r_regionkey) sr
    ON l.l_suppkey = sr.s_suppkey
),
products_c AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         p_brand AS brand, p_retailprice AS base_price, p_retailprice AS price, p_size AS size,
         CAST(p_size * 5e-1 AS DOUBLE) AS margin_pct,
         CAST(p_partkey % 100 * 25e-2 AS DOUBLE) AS popularity_score
  FROM part
),
customers_c AS (
  SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, n.n_name AS location,
         r.r_name AS region, c.c_mktsegment AS segment,
         CAST(c.c_custkey % 13 AS DOUBLE) AS purchase_frequency, CAST(c.c_custkey % 60 + 18 AS DOUBLE) AS age,
         CAST(c.c_custkey % 11 * 125e-3 AS DOUBLE) AS discount_sensitivity
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
master AS (
  SELECT o.order_id, o.product_id, o.customer_id, o.order_date, o.quantity,
         COALESCE(o.price, 0.0) AS price,
         COALESCE(o.total_amount, o.quantity * COALESCE(o.price, 0.0)) AS total_amount,
         COALESCE(o.discount_pct, 0.0) AS discount_pct,
         COALESCE(o.promotion_flag, 0) AS promotion_flag,
         COALESCE(o.channel, 'unknown') AS channel,
         COALESCE(o.payment_method, 'unknown') AS payment_method,
         COALESCE(o.shipping_status, 'unknown') AS shipping_status,
         o.anomaly_flag,
         p.product_name AS product_name,
         COALESCE(p.category, 'general') AS category,
         COALESCE(p.brand, 'generic') AS brand,
         COALESCE(p.base_price, COALESCE(o.price, 0.0)) AS base_price,
         COALESCE(p.margin_pct, 0.0) AS margin_pct, COALESCE(p.popularity_score, 0.0) AS popularity_score,
         COALESCE(c.segment, 'general') AS segment,
         COALESCE(c.purchase_frequency, 0.0) AS purchase_frequency, COALESCE(c.age, 0.0) AS age,
         COALESCE(c.discount_sensitivity, 0.0) AS discount_sensitivity,
         'unknown' AS preferred_channel,
         COALESCE(c.region, 'unknown') AS customer_region,
         COALESCE(o.region, 'unknown') AS order_region,
         CAST(COALESCE(day(o.order_date), 0) AS INTEGER) AS order_day,
         CAST(COALESCE(month(o.order_date), 0) AS INTEGER) AS order_month,
         CAST(COALESCE(isodow(o.order_date) - 1, 0) AS INTEGER) AS order_weekday,
         CAST(COALESCE(isodow(o.order_date) - 1, 0) IN (5, 6) AS INTEGER) AS is_weekend,
         CAST(COALESCE(year(o.order_date), 0) AS INTEGER) AS year,
         COALESCE(strftime(o.order_date, '%Y-%m'), 'NaT') AS month_period,
         o.line_key
  FROM orders_c o
  LEFT JOIN products_c p ON o.product_id = p.product_id
  LEFT JOIN customers_c c ON o.customer_id = c.customer_id
)
"""


def with_ctes(body: str, extra: str = "") -> str:
    """Prefix an oracle query with the adapter CTEs (+ optional extra CTEs)."""
    ctes = ORACLE_CTES.strip()
    if extra:
        ctes = ctes + ",\n" + extra.strip()
    return f"WITH {ctes}\n{body.strip()}"
