import json
import os

import pytest

from ledgerline.functions.repair import resolve_tables
from ledgerline.sources import io as IO


def test_load_csv_missing_raises(spark):
    with pytest.raises(IO.DataValidationError):
        IO.load_csv(spark, IO.unique_scratch(spark, "nope") + "/x.csv")


def test_load_raw_csv_and_normalize_inputs(spark):
    base = IO.unique_scratch(spark, "raw")
    spark.createDataFrame([("P1", "9.5")], ["ProductID", "Unit Price"]).write.option(
        "header", True).csv(f"{base}/product_details.csv")
    spark.createDataFrame([("C1", "North")], ["CustomerID", "Region"]).write.option(
        "header", True).csv(f"{base}/customer_data.csv")
    spark.createDataFrame([("O1", "P1", "C1", "2025-01-01", "2")],
                          ["Order ID", "ProductID", "CustomerID", "OrderDate", "Qty"]).write.option(
        "header", True).csv(f"{base}/order_data.csv")
    raw = IO.load_raw_data(spark, base)
    p, c, o = resolve_tables(raw.products, raw.customers, raw.orders, how="alias", fill=False)
    assert {"product_id", "price"} <= set(p.columns)
    assert "customer_id" in c.columns
    assert {"order_id", "product_id", "customer_id", "order_date"} <= set(o.columns)


def test_load_store_formats(spark):
    base = IO.unique_scratch(spark, "store")
    os.makedirs(base, exist_ok=True)
    rec = {"id": "P1-0", "product_id": "P1", "product_name": "n", "category": "c", "brand": "b",
           "content": "text", "embedding": [0.1, 0.2]}
    with open(f"{base}/wrapped.json", "w") as f:
        json.dump({"records": [rec, dict(rec, id="P1-1")]}, f)
    with open(f"{base}/list.json", "w") as f:
        json.dump([rec], f)
    assert IO.load_store(spark, f"{base}/wrapped.json", fmt="json").count() == 2
    assert IO.load_store(spark, f"{base}/list.json", fmt="json").count() == 1
    with pytest.raises(FileNotFoundError):
        IO.load_store(spark, f"{base}/absent", fmt="json")


def test_export_requires_master(spark):
    with pytest.raises(IO.ModelNotFoundError):
        IO.export_report_csv(spark, IO.unique_scratch(spark, "nomaster"),
                             IO.unique_scratch(spark, "csv"))


def test_csv_quotes_and_nested_columns(spark):
    from pyspark.sql import functions as F
    path = IO.unique_scratch(spark, "quoted")
    df = spark.createDataFrame([(1, 'say "hi", ok')], "k int, v string").withColumn("n", F.struct("k"))
    IO.write_curated(df, path, fmt="csv")
    r = IO.load_csv(spark, path).first()
    assert (r["v"], r["n"]) == ('say "hi", ok', '{"k":1}')
    folder = IO.unique_scratch(spark, "lines")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/a.csv", "w") as f:
        f.write('a,b\n"x ""y"", z","two\nlines"\n')
    r = IO.load_csv(spark, f"{folder}/a.csv", multi_line=True).collect()
    assert [tuple(x) for x in r] == [('x "y", z', "two\nlines")]


def test_partitioned_write_makes_few_files(spark):
    import glob
    path = IO.unique_scratch(spark, "few")
    df = spark.range(1000).selectExpr("id", "id % 3 AS year").repartition(8)
    IO.write_curated(df, path, partition_by=["year"])
    assert len(glob.glob(f"{path}/year=*/*.parquet")) <= 6
    assert IO.read_curated(spark, path).count() == 1000


def test_curated_tables_follow_their_input_files(spark, tmp_path):
    import shutil

    import pyarrow.parquet as pq
    from conftest import SF_SMALL
    from ledgerline.plans.artifacts import curated_master
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", tmp_path)
    n = curated_master(spark, str(tmp_path)).count()
    assert curated_master(spark, str(tmp_path)).count() == n
    lines = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    pq.write_table(lines.slice(0, len(lines) // 2), f"{tmp_path}/lineitem.parquet")
    assert curated_master(spark, str(tmp_path)).count() == len(lines) // 2
