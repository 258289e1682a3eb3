"""Optional cleaning stage.

Training does not call it; it takes raw tables with any headers and is driven
by the ``clean`` values of ``schemas``.  Key de-duplication keeps the row that
comes first by a stated order: a minimum over (order, row) inside an
aggregation, so a key holding a third of all rows is reduced map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.repair import require_columns, resolve
from ..functions.scalars import to_number, to_text


def keep_first(df: DataFrame, key: str, order_key: Column) -> DataFrame:
    """Of each ``key`` the row with the least (``order_key``, row).

    Rows that tie on the order key are told apart by all their columns, so
    the result does not depend on the partitioning.
    """
    tagged = df.select(F.struct(order_key.alias("order"), F.struct(*df.columns).alias("row")).alias("r"))
    return tagged.groupBy(F.col(f"r.row.{key}")).agg(F.min("r").alias("r")).select("r.row.*")


def clean_values(df: DataFrame, table: S.Table) -> DataFrame:
    """Every cleaned column present, coerced and filled."""
    values = {}
    for c in table.columns:
        if c.clean is None:
            continue
        if c.name not in df.columns:
            values[c.name] = F.lit(c.clean)
        else:
            values[c.name] = to_number(c.name, c.clean) if c.kind == "number" else to_text(c.name, c.clean)
    return df.withColumns(values)


def clean(df: DataFrame, table: S.Table, order_key: Column, date_format: str | None = None) -> DataFrame:
    """One cleaned raw table: headers, values, row filters, one row per key.

    ``order_key`` is the row order of the file: an explicit column, because no
    row number of a distributed scan is stable.
    """
    df = clean_values(resolve(df, table, "alias", date_format, fill=False, order=order_key), table)
    for c in table.columns:
        if c.kind == "date":
            require_columns(df, [c.name], table.name)
            df = df.where(F.col(c.name).isNotNull())  # L2
    if table is S.ORDERS:
        df = df.where("quantity > 0")  # L1
    return keep_first(df, table.key, order_key)


def clean_products(products: DataFrame, order_key: Column) -> DataFrame:
    return clean(products, S.PRODUCTS, order_key)


def clean_customers(customers: DataFrame, order_key: Column) -> DataFrame:
    return clean(customers, S.CUSTOMERS, order_key)


def clean_orders(orders: DataFrame, order_key: Column | None = None, date_format: str | None = None) -> DataFrame:
    if order_key is None:
        require_columns(orders, ["line_key"], "orders without an order key")
        order_key = F.col("line_key")
    return clean(orders, S.ORDERS, order_key, date_format)


def clean_all(products: DataFrame, customers: DataFrame, orders: DataFrame, product_order: Column,
              customer_order: Column, line_order: Column,
              date_format: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole stage over the three raw tables."""
    return (clean_products(products, product_order), clean_customers(customers, customer_order),
            clean_orders(orders, line_order, date_format))
