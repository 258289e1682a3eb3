"""Shared oracle CTEs (DuckDB SQL) mirroring the DataFrame operators.

Rounding follows the library rule: money sums through DECIMAL(18,2),
averages ``floor(x * 1e4 + 5e-1) / 1e4`` (never ``round``).
"""

R4 = "floor(({x}) * 1e4 + 5e-1) / 1e4"


def r4(x: str) -> str:
    return R4.format(x=x)


_TEXT = ["category", "brand", "order_region", "customer_region", "channel", "segment"]
_FIRST = ",\n    ".join(
    f"COALESCE(arg_min({c}, line_key) FILTER (WHERE {c} IS NOT NULL), 'unknown') AS {c}"
    for c in _TEXT)

DAILY = f"""
daily AS (
  SELECT product_id, order_date,
    COALESCE(sum(quantity), 0.0) AS quantity,
    COALESCE(CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS total_amount,
    COALESCE({r4('avg(price)')}, 0.0) AS price,
    COALESCE({r4('avg(base_price)')}, 0.0) AS base_price,
    {_FIRST},
    COALESCE({r4('avg(discount_pct)')}, 0.0) AS discount_pct,
    COALESCE(max(promotion_flag), 0) AS promotion_flag,
    COALESCE({r4('avg(purchase_frequency)')}, 0.0) AS purchase_frequency,
    COALESCE({r4('avg(margin_pct)')}, 0.0) AS margin_pct,
    COALESCE({r4('avg(popularity_score)')}, 0.0) AS popularity_score
  FROM master
  WHERE product_id IS NOT NULL AND order_date IS NOT NULL
  GROUP BY product_id, order_date
)"""

DEMAND = f"""
demand AS (
  SELECT product_id, order_date, quantity, total_amount, price, base_price,
    category, brand, order_region, customer_region, channel, segment,
    discount_pct, promotion_flag, purchase_frequency, margin_pct, popularity_score,
    CAST(month(order_date) AS INTEGER) AS order_month,
    CAST(isodow(order_date) - 1 AS INTEGER) AS order_weekday,
    CAST((isodow(order_date) - 1) IN (5, 6) AS INTEGER) AS is_weekend,
    COALESCE(lag(quantity, 1) OVER w, 0.0) AS lag_1_sales,
    COALESCE(lag(quantity, 7) OVER w, 0.0) AS lag_7_sales,
    COALESCE({r4('avg(quantity) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')}, 0.0)
      AS rolling_avg_7,
    quantity AS target_demand
  FROM daily
  WINDOW w AS (PARTITION BY product_id ORDER BY order_date)
)"""

CUSTOMERS = f"""
cust AS (
  SELECT customer_id,
    COALESCE(CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS customer_total_spend,
    count(DISTINCT order_id) AS customer_total_orders,
    {r4('CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) / count(total_amount)')}
      AS avg_order_value,
    max(order_date) AS last_order_date,
    {r4('avg(purchase_frequency)')} AS purchase_frequency,
    {r4('avg(age)')} AS age,
    {r4('avg(discount_sensitivity)')} AS discount_sensitivity,
    CAST(COALESCE(date_diff('day', max(order_date), (SELECT max(order_date) FROM master)), 0)
         AS INTEGER) AS recency_days
  FROM master
  WHERE customer_id IS NOT NULL
  GROUP BY customer_id
)"""

ANOMALY = """
anom AS (
  SELECT order_id, product_id, customer_id, quantity, price, total_amount,
    CASE WHEN quantity > 0 THEN total_amount / quantity ELSE 0.0 END AS unit_price,
    discount_pct, promotion_flag, anomaly_flag
  FROM master
)"""

# order lines as transactions, some of them broken
MASTER_TX = """
tx AS (
  SELECT CAST(order_id AS VARCHAR) AS order_id, CASE WHEN k <> 1 THEN quantity END AS quantity,
    CASE WHEN k = 2 THEN -price ELSE price END AS price,
    CASE WHEN k = 3 THEN -1.0 ELSE discount_pct END AS discount_pct,
    CAST(CASE WHEN k IN (3, 4) THEN 7 ELSE promotion_flag END AS INTEGER) AS promotion_flag
  FROM (SELECT *, CAST(order_id AS BIGINT) % 13 AS k FROM master)
)"""
