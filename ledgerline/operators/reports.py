"""Report visuals (B1-B8) as plain grouped queries over master / demand.

Every report takes optional slicers (``region``, ``category``,
``segment``) that become filters before the aggregation, so they push
down into the scan or the join where possible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import avg4, money_sum, round_half_up


def apply_slicers(master: DataFrame, region: str | None = None, category: str | None = None,
                  segment: str | None = None) -> DataFrame:
    if region is not None:
        master = master.filter(F.col("order_region") == region)
    if category is not None:
        master = master.filter(F.col("category") == category)
    if segment is not None:
        master = master.filter(F.col("segment") == segment)
    return master


def revenue_by_dimension(master: DataFrame, key: str, **slicers) -> DataFrame:
    """B1: revenue, quantity and order lines per category / region."""
    m = apply_slicers(master, **slicers)
    return m.groupBy(key).agg(
        money_sum("total_amount").alias("revenue"),
        F.sum("quantity").alias("total_quantity"),
        F.count(F.lit(1)).alias("order_lines"),
    )


def monthly_revenue(master: DataFrame, **slicers) -> DataFrame:
    """B2: revenue and distinct orders per month ("NaT" for no date)."""
    m = apply_slicers(master, **slicers)
    return m.groupBy("month_period").agg(
        money_sum("total_amount").alias("revenue"),
        F.countDistinct("order_id").alias("orders"),
    )


def product_demand(master: DataFrame, **slicers) -> DataFrame:
    """Total quantity and mean price per product."""
    m = apply_slicers(master, **slicers)
    return m.groupBy("product_id").agg(
        F.sum("quantity").alias("total_quantity"),
        avg4("price").alias("avg_price"),
        money_sum("total_amount").alias("revenue"),
    )


def anomaly_by_region(anomaly_master: DataFrame, **slicers) -> DataFrame:
    """Lines, flagged lines, flag rate and revenue per order region."""
    m = apply_slicers(anomaly_master, **slicers)
    flag = F.coalesce(F.col("anomaly_flag").cast("int"), F.lit(0))
    return m.groupBy("order_region").agg(
        F.count(F.lit(1)).alias("order_lines"),
        F.sum(flag).cast("long").alias("anomaly_lines"),
        round_half_up(F.avg(flag), 4).alias("anomaly_rate"),
        money_sum("total_amount").alias("revenue"),
        money_sum(F.when(flag == 1, F.col("total_amount"))).alias("flagged_revenue"),
    )


def customers_by_flag_payment(master: DataFrame, **slicers) -> DataFrame:
    """Distinct customers per anomaly flag x payment method."""
    m = apply_slicers(master, **slicers)
    return m.groupBy("anomaly_flag", "payment_method").agg(
        F.countDistinct("customer_id").alias("customers"))


def discount_by_category(master: DataFrame, **slicers) -> DataFrame:
    """Mean discount per category."""
    m = apply_slicers(master, **slicers)
    return m.groupBy("category").agg(avg4("discount_pct").alias("avg_discount_pct"))


def customers_by_segment_region(master: DataFrame, **slicers) -> DataFrame:
    """Distinct customers per segment x customer region."""
    m = apply_slicers(master, **slicers)
    return m.groupBy("segment", "customer_region").agg(
        F.countDistinct("customer_id").alias("customers"))


def revenue_by_segment_brand(master: DataFrame, **slicers) -> DataFrame:
    """Revenue per segment x brand."""
    m = apply_slicers(master, **slicers)
    return m.groupBy("segment", "brand").agg(money_sum("total_amount").alias("revenue"))


def lag_snapshot(demand: DataFrame) -> DataFrame:
    """Per product the mean lags next to its total demand."""
    return demand.groupBy("product_id").agg(
        F.sum("quantity").alias("total_quantity"), avg4("lag_1_sales").alias("avg_lag_1"),
        avg4("lag_7_sales").alias("avg_lag_7"), avg4("rolling_avg_7").alias("avg_rolling_7"))


def price_vs_quantity(demand: DataFrame) -> DataFrame:
    """Daily price and quantity points, by category."""
    return demand.groupBy("category", "price").agg(
        F.sum("quantity").alias("total_quantity"), F.count(F.lit(1)).alias("product_days"))


def flag_distribution(anomaly: DataFrame) -> DataFrame:
    """Lines and revenue per anomaly flag."""
    return anomaly.groupBy("anomaly_flag").agg(
        F.count(F.lit(1)).alias("order_lines"), money_sum("total_amount").alias("revenue"))


def flagged_orders(anomaly: DataFrame) -> DataFrame:
    """The flagged lines."""
    return anomaly.where("anomaly_flag = 1").select(
        "order_id", "product_id", "customer_id", "quantity", "price", "total_amount", "discount_pct")


def spend_vs_frequency(customers: DataFrame) -> DataFrame:
    """Customers and their spend per purchase frequency."""
    return customers.groupBy("purchase_frequency").agg(
        F.count(F.lit(1)).alias("customers"), money_sum("customer_total_spend").alias("spend"),
        F.sum("customer_total_orders").cast("long").alias("orders"))


def customer_table(customers: DataFrame) -> DataFrame:
    """One line per customer with order value and recency."""
    return customers.select("customer_id", "customer_total_spend", "customer_total_orders", "avg_order_value",
                            "recency_days", "age", "discount_sensitivity")


def feature_summary(demand: DataFrame) -> DataFrame:
    """Feature averages per category plus a grand-total row.

    Sums and counts by category first; the rollup (``category`` null is the
    total) then doubles those few rows instead of all demand rows.
    """
    means = {"avg_lag_1": "lag_1_sales", "avg_rolling_7": "rolling_avg_7", "avg_margin_pct": "margin_pct",
             "avg_discount_pct": "discount_pct"}
    by_category = demand.groupBy("category").agg(
        *(F.sum(c).alias(f"s_{name}") for name, c in means.items()),
        *(F.count(c).alias(f"n_{name}") for name, c in means.items()),
        F.sum("lag_7_sales").alias("sum_lag_7"), F.count(F.lit(1)).alias("product_days"))
    return by_category.rollup("category").agg(
        *(round_half_up(F.sum(f"s_{name}") / F.sum(f"n_{name}"), 4).alias(name) for name in means),
        F.sum("sum_lag_7").alias("sum_lag_7"), F.sum("product_days").alias("product_days"))


def revenue_ytd(master: DataFrame, **slicers) -> DataFrame:
    """Daily revenue and its year-to-date running total.

    The window runs over *daily totals* partitioned by year, never over
    lines; running sums stay DECIMAL so they are exact.
    """
    m = apply_slicers(master, **slicers).filter(F.col("order_date").isNotNull())
    daily = m.groupBy("year", "order_date").agg(
        F.sum(F.col("total_amount").cast("decimal(18,2)")).alias("rev"))
    w = Window.partitionBy("year").orderBy("order_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return daily.select(
        "year", "order_date",
        F.col("rev").cast("double").alias("revenue"),
        F.sum("rev").over(w).cast("double").alias("revenue_ytd"),
    )


def category_distribution(master: DataFrame, **slicers) -> DataFrame:
    """Lines per category and their share of all lines.

    The total is a scalar subquery (no unpartitioned window, which would
    move every group into one task).
    """
    m = apply_slicers(master, **slicers)
    g = m.groupBy("category").agg(F.count(F.lit(1)).alias("order_lines"))
    total = g.select(F.sum("order_lines")).scalar()
    return g.select("category", "order_lines",
                    round_half_up(F.col("order_lines") / total, 4).alias("share"))
