import pytest
from pyspark.sql import functions as F

from ledgerline import schemas as S
from ledgerline.functions.repair import as_date, normalize_columns, resolve_tables, source_of
from ledgerline.functions.scalars import (blank_to_default, date_parts, round_half_up, to_number,
                                          to_timestamp_safe, unit_price)


def test_normalize_and_find(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" Product_ID ", "Unit-Price", "qty"])
    out = normalize_columns(df)
    assert out.columns == ["product_id", "unit-price", "qty"]
    out2 = normalize_columns(df, underscores=True)
    assert out2.columns == ["product_id", "unit_price", "qty"]
    assert source_of(S.PRODUCTS.column("product_id"), ["sku", "my product id"], "search") == "my product id"
    assert source_of(S.ORDERS.column("order_id"), out.columns, "search") is None


def test_duplicate_headers_keep_first(spark):
    df = spark.createDataFrame([(1, 2)], ["A", "a "])
    out = normalize_columns(df)
    assert out.columns == ["a"]
    assert out.first()["a"] == 1


def test_resolve_keys_odd_headers(spark):
    p = spark.createDataFrame([("P1", "x")], ["Product ID", "Name"])
    c = spark.createDataFrame([("C1",)], ["CustomerID"])
    o = spark.createDataFrame([("O1", "P1", "C1", "3", "9.5", "2025-01-02")],
                              ["Order_Id", "Product-Id", "customer_id", "Qty", "Unit Price", "Date"])
    p2, c2, o2 = resolve_tables(p, c, o)
    assert "product_id" in p2.columns and "customer_id" in c2.columns
    assert {"order_id", "product_id", "customer_id", "quantity", "price", "order_date"} <= set(o2.columns)
    r = o2.first()
    assert str(r["order_date"]).startswith("2025-01-02")


def test_resolve_keys_missing_raises(spark):
    p = spark.createDataFrame([("P1",)], ["sku"])
    c = spark.createDataFrame([("C1",)], ["customer_id"])
    o = spark.createDataFrame([("O1", "P1", "C1", 1, 1.0, "2025-01-01")],
                              ["order_id", "product_id", "customer_id", "quantity", "price", "order_date"])
    with pytest.raises(ValueError, match="products: no header means product_id"):
        resolve_tables(p, c, o)


def test_bad_values_coerce(spark):
    df = spark.createDataFrame([("x", "bad", None), ("2", "2025-03-04", "1.5")], "q string, d string, p string")
    rows = df.select(to_number("q").alias("q"), to_timestamp_safe("d").alias("d"),
                     to_number("p").alias("p")).collect()
    assert rows[0]["q"] == 0.0 and rows[0]["d"] is None and rows[0]["p"] == 0.0
    assert rows[1]["q"] == 2.0 and rows[1]["p"] == 1.5


def test_unit_price_and_blank(spark):
    df = spark.createDataFrame([(0.0, 10.0, "  "), (2.0, 10.0, " a ")], "q double, t double, s string")
    r = df.select(unit_price("t", "q").alias("u"), blank_to_default("s", "dflt").alias("s")).collect()
    assert r[0]["u"] == 0.0 and r[1]["u"] == 5.0
    assert r[0]["s"] == "dflt" and r[1]["s"] == "a"


def test_date_parts_null_date(spark):
    df = spark.createDataFrame([(None,)], "d timestamp")
    parts = date_parts(F.col("d"))
    r = df.select(*[v.alias(k) for k, v in parts.items()]).first()
    assert r["order_day"] == 0 and r["order_weekday"] == 0 and r["is_weekend"] == 0
    assert r["month_period"] == "NaT"


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([("2025-06-01",), ("2025-06-02",)], "d string")  # Sunday, Monday
    parts = date_parts(F.to_timestamp("d"))
    r = df.select(parts["order_weekday"].alias("w"), parts["is_weekend"].alias("we")).collect()
    assert (r[0]["w"], r[0]["we"]) == (6, 1)
    assert (r[1]["w"], r[1]["we"]) == (0, 0)


def test_round_half_up_floor_rule(spark):
    df = spark.createDataFrame([(0.12345,), (1.00005,), (-0.00005,)], "x double")
    r = [x[0] for x in df.select(round_half_up("x", 4)).collect()]
    assert r[0] == 0.1235
    assert all(abs(v * 1e4 - round(v * 1e4)) < 1e-6 for v in r)


def test_blank_means_unicode_white_space(spark):
    df = spark.createDataFrame([("\t\n",), ("\u00a0 a b\t",), (None,)], "s string")
    assert [r[0] for r in df.select(blank_to_default("s", "none")).collect()] == ["none", "a b", "none"]


def test_text_dates_by_format_or_found_pattern(spark):
    p = spark.createDataFrame([("P1",)], ["product_id"])
    c = spark.createDataFrame([("C1",)], ["customer_id"])
    o = spark.createDataFrame([("O1", "P1", "C1", 1, 1.0, "15/01/2025")],
                              ["order_id", "product_id", "customer_id", "quantity", "price", "order_date"])
    assert resolve_tables(p, c, o, date_format="dd/MM/yyyy")[2].first()["order_date"].month == 1
    assert resolve_tables(p, c, o)[2].first()["order_date"].month == 1


def test_aliases_are_added_beside_their_source(spark):
    from ledgerline.functions.repair import resolve
    df = spark.createDataFrame([("P1", "2.5")], ["ProductID", "Unit Price"])
    out = resolve(df, S.PRODUCTS, "alias", fill=False)
    assert out.columns == ["productid", "unit_price", "product_id", "price"]


@pytest.mark.parametrize("values", [
    ["2025-01-02", "2025-03-04 10:00:00", "03/04/2025", None, "x", "2025-13-01"],
    ["31/12/2024", "01/02/2025", "2025-01-02", "12/31/2024"], ["01/02/2025", "31/12/2024", "12/31/2024"],
    ["1/2/2025", "12/31/2024", "02/29/2023", "02/29/2024"], [None, "2025/03/04", "2025-03-04"], ["04.05.2025", "30.05.2025", "12.30.2024"],
    ["02 Mar 2025", "3 Apr 2025", "March 4, 2025"], ["Mar 2, 2025", "Apr 30, 2025", "March 4, 2025"], ["April 2, 2025", "June 30, 2025", "Jun 30, 2025"],
    ["20250304", "20251332", "2025-03-04"], ["2025-01-02 10:20:30", "2025-01-03 00:00:01", "2025-01-03"],
    ["2025-01-02T10:20:30", "2025-01-03T00:00:01", "01/03/2025"], ["12/31/2024 10:20", "1/3/2025 23:59", "1/3/2025"], ["02-Mar-2025", "03-Apr-2025", "2025-03-04"]])
def test_one_pattern_from_the_first_value(spark, values):
    """Against the data frame library whose rule it is: the first value's
    format reads the column, the rest becomes null."""
    import warnings
    import pandas as pd
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = [None if pd.isna(v) else v.to_pydatetime() for v in pd.to_datetime(pd.Series(values, dtype=object), errors="coerce")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, d string").repartition(3)
    got = df.select("k", as_date(df, "d", order=F.col("k")).alias("t")).orderBy("k").collect()
    assert [r.t for r in got] == want


def test_a_broken_first_value_leaves_each_its_own_pattern(spark):
    df = spark.createDataFrame([(1, "31/31/2025"), (2, "2025-01-02"), (3, "13/02/2025"), (4, "02/03/2025")], "k long, d string")
    got = [r.t and (r.t.month, r.t.day) for r in df.select("k", as_date(df, "d", order=F.col("k")).alias("t")).orderBy("k").collect()]
    assert got == [None, (1, 2), (2, 13), (2, 3)]


def test_pattern_without_an_order_is_the_most_frequent(spark):
    df = spark.createDataFrame([("2025-01-02",), ("31/12/2024",), ("30/11/2024",), ("x",), (None,)], "d string")
    got = {r.d: r.t for r in df.select("d", as_date(df, "d").alias("t")).collect()}
    assert got["31/12/2024"].month == 12 and got["2025-01-02"] is None and got["x"] is None
    assert df.limit(0).select(as_date(df.limit(0), "d")).count() == 0
