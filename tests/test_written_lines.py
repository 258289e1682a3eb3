"""What is moved and written for the partitioned master and for the training rows of the demand."""
import os

from conftest import SF_SMALL
from pyspark.sql import functions as F
from test_demand_shuffles import odd_tables
from test_master_shuffles import line_shuffles

from ledgerline.models import demand as DM
from ledgerline.operators import features as feat
from ledgerline.operators.master import MASTER_COLUMNS, master_from_sf
from ledgerline.plans.registry import all_queries
from ledgerline.sources import io as IO

OPEN = "spark.sql.maxConcurrentOutputFileWriters"


def files_of(path):
    return [f"{folder}/{f}" for folder, _, names in os.walk(path.removeprefix("file:")) for f in names if f.endswith(".parquet")]


def test_rows_of_few_values_are_written_where_they_are(spark, tmp_path):
    rows = spark.range(400).repartition(3, "id").select("id", (F.col("id") % 2).alias("year"))
    before = spark.conf.get(OPEN, "0")
    for n, path in ((2, f"{tmp_path}/few"), (MANY := 40, f"{tmp_path}/many")):
        table = rows.withColumn("year", F.col("id") % n)
        IO.write_curated(table, path, partition_by=["year"], in_place=True)
        back = IO.read_curated(spark, path).select("id", F.col("year").cast("long").alias("year"))
        assert back.exceptAll(table).isEmpty() and table.exceptAll(back).isEmpty()
    assert len(files_of(f"{tmp_path}/few")) == 6 and MANY > IO.MOST_OPEN
    assert spark.conf.get(OPEN, "0") == before


def test_partitioned_master_is_not_dealt_by_year(spark, monkeypatch):
    written, write = [], IO.write_curated

    def record(df, path, **how):
        written.append((df.columns, path, how))
        write(df, path, **how)

    monkeypatch.setattr(IO, "write_curated", record)
    found = all_queries()["curated_roundtrip"].build(spark, SF_SMALL)
    (columns, path, how), = written
    assert how["in_place"] and how["partition_by"] == ["year"]
    plain = master_from_sf(spark, SF_SMALL)
    assert columns == plain.columns and "product_description" in columns  # every column is written
    assert all(f.endswith(".zstd.parquet") for f in files_of(path))
    plain = plain.select(*MASTER_COLUMNS)
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()


def test_training_rows_move_lines_by_product_once(spark, tmp_path, monkeypatch):
    path = odd_tables(tmp_path)
    want = DM.train_rows(feat.demand_features(master_from_sf(spark, path)))
    found = all_queries()["demand_train_rows"].build(spark, path)
    assert found.columns == want.columns and want.count() > 200
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    monkeypatch.setattr(DM, "train_rows", lambda demand: demand)
    moved = line_shuffles(all_queries()["demand_train_rows"].build(spark, path))
    assert moved and not any("order_date" in keys for keys in moved)
