"""KPIs and model-quality metrics (A4-A11, G2, G5) as single aggregations.

Every metric is one ``agg`` over the input (partial aggregation on the
map side, one tiny final stage); nothing is collected to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import money_sum, round_half_up


def kpis(master: DataFrame, approximate: bool = False) -> DataFrame:
    """A4: distinct orders/products/customers, revenue, mean line value.

    ``approximate=True`` swaps the exact distinct counts (one Expand and a
    shuffle per distinct key) for HyperLogLog sketches.
    """
    cd = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.countDistinct(c))
    return master.agg(
        cd("order_id").alias("total_orders"),
        cd("product_id").alias("total_products"),
        cd("customer_id").alias("total_customers"),
        round_half_up(money_sum("total_amount"), 2).alias("total_revenue"),
        round_half_up(F.sum(F.col("total_amount").cast("decimal(18,2)")).cast("double")
                      / F.count("total_amount"), 2).alias("average_order_value"),
    )


def revenue_by(master: DataFrame, *keys: str) -> DataFrame:
    """A5 / B1: revenue per group (null group keys dropped, as pandas does)."""
    m = master
    for k in keys:
        m = m.filter(F.col(k).isNotNull())
    return m.groupBy(*keys).agg(money_sum("total_amount").alias("revenue"))


def top_categories(master: DataFrame, k: int = 5) -> DataFrame:
    """A5 + K2: top-k categories by revenue (category name breaks ties).

    Planned as TakeOrderedAndProject: each partition keeps k rows.
    """
    return (revenue_by(master, "category")
            .orderBy(F.desc("revenue"), F.asc("category")).limit(k)
            .select("category", round_half_up(F.col("revenue"), 2).alias("revenue")))


def top_categories_map(master: DataFrame, k: int = 5) -> DataFrame:
    """The top-k categories as one ``map<string,double>`` value."""
    t = top_categories(master, k)
    return t.agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("category").cast("string"), "revenue"))).alias("top_categories"))


def anomaly_label_rate(anomaly: DataFrame, label: str = "anomaly_flag") -> DataFrame:
    """Labelled anomaly count and rate (nulls ignored)."""
    return anomaly.agg(
        F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("labeled_anomaly_count"),
        round_half_up(F.avg(label), 4).alias("labeled_anomaly_rate"),
    )


def prediction_counts(scored: DataFrame, flag: str = "anomaly_pred") -> DataFrame:
    """Predicted anomaly / normal counts and rate (0.0 on no rows)."""
    return scored.agg(
        F.count("*").alias("rows_total"),
        F.count_if(F.col(flag) == 1).alias("anomaly_count"),
        (F.count("*") - F.count_if(F.col(flag) == 1)).alias("normal_count"),
        F.coalesce(F.try_divide(F.count_if(F.col(flag) == 1), F.count("*")),
                   F.lit(0.0)).alias("anomaly_rate"),
    )


def classification_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """A9 + F13: accuracy, precision, recall, F1 (zero_division = 0).

    The label is coerced (bad or null -> 0, integer) before counting.
    """
    y = F.coalesce(F.col(label).try_cast("double"), F.lit(0.0)).cast("int")
    p = F.coalesce(F.col(pred).try_cast("double"), F.lit(0.0)).cast("int")
    c = df.select(y.alias("y"), p.alias("p")).agg(
        F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"),
        F.count_if((F.col("y") != 1) & (F.col("p") == 1)).alias("fp"),
        F.count_if((F.col("y") == 1) & (F.col("p") != 1)).alias("fn"),
        F.count_if((F.col("y") != 1) & (F.col("p") != 1)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return c.select(
        "tp", "fp", "fn", "tn",
        round_half_up(F.when(tp + fp + fn + tn > 0, (tp + tn) / (tp + fp + fn + tn))
                      .otherwise(0.0), 4).alias("accuracy"),
        round_half_up(prec, 4).alias("precision"),
        round_half_up(rec, 4).alias("recall"),
        round_half_up(F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0), 4)
        .alias("f1_score"),
    )


def anomaly_metrics(scored: DataFrame, label: str, pred: str) -> DataFrame:
    """A8 + A9 in one pass: predicted counts/rate and label metrics."""
    c = classification_metrics(scored, label, pred)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(
        n.alias("rows_total"), (F.col("tp") + F.col("fp")).alias("anomaly_count"),
        (F.col("fn") + F.col("tn")).alias("normal_count"),
        F.coalesce(F.try_divide(F.col("tp") + F.col("fp"), n), F.lit(0.0)).alias("anomaly_rate"),
        F.lit(label).alias("label_column"), "accuracy", "precision", "recall", "f1_score")


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """A10: R^2, MAE, MSE, RMSE in one pass."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    s = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.var_pop(y).alias("var"),
        F.sum((y - p) * (y - p)).alias("sse"), F.sum(F.abs(y - p)).alias("sae"),
    )
    n = F.col("n").cast("double")
    sst = F.col("var") * n  # not a difference of large sums
    mse = F.col("sse") / n
    return s.select(
        F.col("n").alias("rows_test"),
        round_half_up(F.when(sst > 0, 1 - F.col("sse") / sst), 4).alias("r2_score"),
        round_half_up(F.col("sae") / n, 4).alias("mae"),
        round_half_up(mse, 4).alias("mse"),
        round_half_up(F.sqrt(mse), 4).alias("rmse"),
    )


def row_counts(**tables: DataFrame) -> DataFrame:
    """One (table, rows) row per named table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def cluster_sizes(segments: DataFrame, col: str = "cluster") -> DataFrame:
    """A7 + K3: customers per cluster, largest first."""
    return (segments.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(col)))
