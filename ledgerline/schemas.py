"""The three raw tables as data: one rule per canonical column.

Everything that repairs, cleans or joins the tables reads these rules, so a
new column or another spelling is one line here.  ``MASTER_COLUMNS`` and the
defaults are fixed values of the output format.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Column:
    """A canonical column.

    ``kind``: key, text, number, flag, date or label.  ``words``: alternative
    sets of words, all of one set standing in a header that means this column.
    ``aliases``: whole headers with the same meaning.  ``default``: a value, or
    ``"=name"`` for the value of another column.  ``clean``: the value that the
    cleaning stage fills in (None: it leaves the column alone).
    """

    name: str
    kind: str
    words: tuple[tuple[str, ...], ...] = ()
    aliases: tuple[str, ...] = ()
    default: object = None
    required: bool = False
    clean: object = None


@dataclass(frozen=True)
class Table:
    name: str
    key: str
    columns: tuple[Column, ...]

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


PRODUCTS = Table("products", "product_id", (
    Column("product_id", "key", (("product", "id"),), ("productid",), required=True, clean="unknown"),
    Column("product_name", "text", default="=product_id", clean="unknown"),
    Column("category", "text", default="general", clean="unknown"),
    Column("brand", "text", default="generic", clean="unknown"),
    Column("price", "number", aliases=("unit_price",), clean=0.0),
    Column("base_price", "number", default=0.0),
    Column("margin_pct", "number", default=0.0),
    Column("popularity_score", "number", default=0.0),
))

CUSTOMERS = Table("customers", "customer_id", (
    Column("customer_id", "key", (("customer", "id"),), ("customerid",), required=True, clean="unknown"),
    Column("region", "text", default="=location", clean="unknown"),
    Column("segment", "text", default="general", clean="unknown"),
    Column("purchase_frequency", "number", default=0.0),
    Column("age", "number", default=0.0),
    Column("discount_sensitivity", "number", default=0.0),
    Column("preferred_channel", "text", default="unknown"),
))

ORDERS = Table("orders", "order_id", (
    Column("order_id", "key", (("order", "id"),), required=True, clean="unknown"),
    Column("product_id", "key", (("product", "id"),), ("productid",), required=True, clean="unknown"),
    Column("customer_id", "key", (("customer", "id"),), ("customerid",), required=True, clean="unknown"),
    Column("quantity", "number", (("qty",), ("quantity",)), required=True, clean=1.0),
    Column("price", "number", (("price",),), required=True),
    Column("order_date", "date", (("date",),), ("orderdate", "date"), required=True),
    Column("discount_pct", "number", default=0.0),
    Column("promotion_flag", "flag", default=0),
    Column("channel", "text", default="unknown"),
    Column("payment_method", "text", default="unknown"),
    Column("shipping_status", "text", default="unknown"),
    Column("region", "text", default="unknown"),
    Column("anomaly_flag", "label"),
))

# The master table's columns, in its order.
MASTER_COLUMNS = [
    "order_id", "product_id", "customer_id", "order_date", "quantity", "price",
    "total_amount", "discount_pct", "promotion_flag", "channel", "payment_method",
    "shipping_status", "anomaly_flag", "product_name", "category", "brand",
    "base_price", "margin_pct", "popularity_score", "segment", "purchase_frequency",
    "age", "discount_sensitivity", "preferred_channel", "customer_region",
    "order_region", "order_day", "order_month", "order_weekday", "is_weekend",
    "year", "month_period",
]

# Columns of the feature tables and of the models' inputs.
DEMAND_TEXT_COLUMNS = ["category", "brand", "order_region", "customer_region", "channel", "segment"]

DEMAND_COLUMNS = [
    "product_id", "order_date", "quantity", "total_amount", "price", "base_price",
    "category", "brand", "order_region", "customer_region", "channel", "segment",
    "discount_pct", "promotion_flag", "purchase_frequency", "margin_pct",
    "popularity_score", "order_month", "order_weekday", "is_weekend",
    "lag_1_sales", "lag_7_sales", "rolling_avg_7", "target_demand",
]

DEMAND_FEATURES = [
    "product_id", "category", "brand", "order_region", "customer_region", "channel",
    "segment", "price", "base_price", "order_month", "order_weekday", "is_weekend",
    "lag_1_sales", "lag_7_sales", "rolling_avg_7", "discount_pct", "promotion_flag",
    "purchase_frequency", "margin_pct", "popularity_score",
]
DEMAND_CATEGORICAL = DEMAND_FEATURES[:7]
DEMAND_NUMERIC = DEMAND_FEATURES[7:]

ANOMALY_FEATURES = ["quantity", "price", "total_amount", "unit_price", "discount_pct",
                    "promotion_flag"]

CLUSTER_FEATURES = ["customer_total_spend", "customer_total_orders", "avg_order_value",
                    "recency_days", "purchase_frequency", "age", "discount_sensitivity"]

_TYPES = {"key": T.StringType(), "text": T.StringType(), "number": T.DoubleType(), "flag": T.IntegerType(),
          "date": T.TimestampType(), "label": T.DoubleType()}


def struct_of(table: Table) -> T.StructType:
    """The canonical schema of a raw table, for readers of typed files."""
    return T.StructType([T.StructField(c.name, _TYPES[c.kind]) for c in table.columns])
