"""Feature tables derived from the master table.

* ``demand_daily``     A1: one row per (product, day)
* ``demand_features``  A1 + W1-W3: lags and 7-row rolling mean per product
* ``customer_features`` A2 + A3 + F10: spend, orders, recency per customer
* ``anomaly_features`` P11 + F9: per-line anomaly inputs
* ``latest_by_product`` W4: the last demand row of every product

Plan notes (see README "Scale"):
- demand: the line -> (product, day) aggregation shuffles on both keys
  with map-side partial aggregation, so a product holding a third of all
  lines is spread over its days; the window then shuffles the *daily*
  rows by product, whose count per product is bounded by the calendar.
- customers: two aggregations ((customer, order) then customer) instead
  of ``countDistinct``, so there is no Expand and the hot customer is
  pre-aggregated per order before its final shuffle.
- the global last order date is a scalar subquery, not a driver round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import avg4, first_by_order, money_sum, round_half_up, unit_price
from ..schemas import (ANOMALY_FEATURES, CLUSTER_FEATURES, DEMAND_CATEGORICAL, DEMAND_COLUMNS,  # noqa: F401
                       DEMAND_FEATURES, DEMAND_NUMERIC, DEMAND_TEXT_COLUMNS)

def _order_key(master: DataFrame):
    """The row order of the order table: ``line_key``, or else the row's own
    columns (a row number of a distributed scan would not be stable)."""
    if "line_key" in master.columns:
        return F.col("line_key")
    return F.struct(*(c for c in ("order_id", "customer_id", "quantity", "price", "total_amount",
                                  *DEMAND_TEXT_COLUMNS) if c in master.columns))


def demand_daily(master: DataFrame, filled: bool = True, day_grain: bool = False) -> DataFrame:
    """A1: aggregate lines to (product_id, order_date).

    Rows with a null product or date are dropped (pandas drops null group
    keys).  ``first`` follows the order table's row order (``line_key``).
    Averages are rounded to 4 digits with the floor rule.

    ``filled`` states that the text columns hold no nulls, which the master
    guarantees (a schema read back from files no longer says so); with
    ``filled=False`` each column skips its own nulls.  ``day_grain`` cuts the
    date to the day, which bounds a product's rows by the calendar where
    order dates carry a time.
    """
    key = _order_key(master)
    m = master.filter(F.col("product_id").isNotNull() & F.col("order_date").isNotNull())
    if day_grain:
        m = m.withColumn("order_date", F.date_trunc("day", "order_date"))
    aggs = [
        F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"),
        money_sum("total_amount").alias("total_amount"),
        F.coalesce(avg4("price"), F.lit(0.0)).alias("price"),
        F.coalesce(avg4("base_price"), F.lit(0.0)).alias("base_price"),
    ]
    if filled:
        # one struct minimum led by the row-order key picks the first line's
        # values for all six columns with one aggregation buffer
        aggs.append(F.min(F.struct(key.alias("__k"), *DEMAND_TEXT_COLUMNS)).alias("__first"))
    else:
        aggs += [F.coalesce(first_by_order(c, key), F.lit("unknown")).alias(c)
                 for c in DEMAND_TEXT_COLUMNS]
    aggs += [
        F.coalesce(avg4("discount_pct"), F.lit(0.0)).alias("discount_pct"),
        F.coalesce(F.max("promotion_flag"), F.lit(0)).alias("promotion_flag"),
        F.coalesce(avg4("purchase_frequency"), F.lit(0.0)).alias("purchase_frequency"),
        F.coalesce(avg4("margin_pct"), F.lit(0.0)).alias("margin_pct"),
        F.coalesce(avg4("popularity_score"), F.lit(0.0)).alias("popularity_score"),
    ]
    out = m.groupBy("product_id", "order_date").agg(*aggs)
    if "__first" in out.columns:
        out = out.select(*[F.col(f"__first.{c}").alias(c) if c in DEMAND_TEXT_COLUMNS else c
                           for c in ["product_id", "order_date", "quantity", "total_amount",
                                     "price", "base_price", *DEMAND_TEXT_COLUMNS,
                                     "discount_pct", "promotion_flag", "purchase_frequency",
                                     "margin_pct", "popularity_score"]])
    return out


def add_demand_windows(daily: DataFrame, exclude_current: bool = False) -> DataFrame:
    """W1-W3 over rows (not calendar days) of each product.

    ``rolling_avg_7`` includes the current row by default, as the reference
    does (so it leaks the target); ``exclude_current=True`` uses the seven
    previous rows instead.
    """
    w = Window.partitionBy("product_id").orderBy("order_date")
    frame = w.rowsBetween(-7, -1) if exclude_current else w.rowsBetween(-6, 0)
    wd = F.weekday("order_date")
    return daily.select(
        *[c for c in daily.columns],
        F.month("order_date").alias("order_month"),
        wd.alias("order_weekday"),
        wd.isin(5, 6).cast("int").alias("is_weekend"),
        F.coalesce(F.lag("quantity", 1).over(w), F.lit(0.0)).alias("lag_1_sales"),
        F.coalesce(F.lag("quantity", 7).over(w), F.lit(0.0)).alias("lag_7_sales"),
        F.coalesce(round_half_up(F.avg("quantity").over(frame), 4), F.lit(0.0))
         .alias("rolling_avg_7"),
        F.col("quantity").alias("target_demand"),
    ).select(*DEMAND_COLUMNS)


def demand_features(master: DataFrame, exclude_current: bool = False,
                    single_shuffle: bool = False) -> DataFrame:
    """A1 + W1-W3: the demand dataset (24 columns).

    ``single_shuffle=True`` hash-partitions lines by product first so the
    aggregation and the window share one exchange; only use it when no
    product is hot and lines barely reduce to days.
    """
    if single_shuffle:
        master = master.repartition("product_id")
    return add_demand_windows(demand_daily(master), exclude_current)


def customer_features(master: DataFrame) -> DataFrame:
    """A2 + A3 + F10: one row per customer."""
    m = master.filter(F.col("customer_id").isNotNull())
    # Scalar subquery: over a materialised master table (the training job
    # writes and re-reads it) this reads one column; over a lazy plan it
    # re-runs that plan once.
    latest = master.select(F.max("order_date")).scalar()
    per_order = m.groupBy("customer_id", "order_id").agg(
        F.sum(F.col("total_amount").cast("decimal(18,2)")).alias("spend"),
        F.count("total_amount").alias("n_lines"),
        F.max("order_date").alias("last_date"),
        F.sum("purchase_frequency").alias("s_pf"), F.count("purchase_frequency").alias("n_pf"),
        F.sum("age").alias("s_age"), F.count("age").alias("n_age"),
        F.sum("discount_sensitivity").alias("s_ds"), F.count("discount_sensitivity").alias("n_ds"),
    )
    agg = per_order.groupBy("customer_id").agg(
        F.coalesce(F.sum("spend").cast("double"), F.lit(0.0)).alias("customer_total_spend"),
        F.count("order_id").alias("customer_total_orders"),
        (F.sum("spend").cast("double") / F.sum("n_lines")).alias("_aov"),
        F.max("last_date").alias("last_order_date"),
        (F.sum("s_pf") / F.sum("n_pf")).alias("_pf"),
        (F.sum("s_age") / F.sum("n_age")).alias("_age"),
        (F.sum("s_ds") / F.sum("n_ds")).alias("_ds"),
    )
    return agg.select(
        "customer_id", "customer_total_spend", "customer_total_orders",
        round_half_up(F.col("_aov"), 4).alias("avg_order_value"),
        "last_order_date",
        round_half_up(F.col("_pf"), 4).alias("purchase_frequency"),
        round_half_up(F.col("_age"), 4).alias("age"),
        round_half_up(F.col("_ds"), 4).alias("discount_sensitivity"),
        F.coalesce(F.timestamp_diff("DAY", F.col("last_order_date"), latest), F.lit(0))
         .cast("int").alias("recency_days"),
    )


def anomaly_features(master: DataFrame, drop_null_features: bool = True) -> DataFrame:
    """P11 + F9 (+ L4): per-line anomaly inputs."""
    cols = ["order_id", "product_id", "customer_id", "quantity", "price", "total_amount",
            unit_price("total_amount", "quantity").alias("unit_price"),
            "discount_pct", "promotion_flag"]
    if "anomaly_flag" in master.columns:
        cols.append("anomaly_flag")
    out = master.select(*cols)
    if drop_null_features:
        out = out.na.drop(subset=ANOMALY_FEATURES)
    return out


def latest_by_product(demand: DataFrame) -> DataFrame:
    """The last (by date) demand row of each product.

    The row without a successor in the window that the lags use: demand that
    was just computed is partitioned and sorted for it already.
    """
    w = Window.partitionBy("product_id").orderBy("order_date")
    return demand.withColumn("__next", F.lead("order_date").over(w)).where("__next IS NULL").drop("__next")
