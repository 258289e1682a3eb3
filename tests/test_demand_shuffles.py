"""What moves and what is written on the way to the daily demand, the curated master and the segments."""

import datetime as dt
import os
import shutil

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from conftest import SF_SMALL
from pyspark.sql import functions as F
from test_master_shuffles import line_shuffles

from ledgerline.adapter import raw_tables
from ledgerline.operators import features as feat
from ledgerline.operators.master import MASTER_COLUMNS, build_master
from ledgerline.plans import artifacts
from ledgerline.plans.registry import all_queries


def odd_tables(path):
    """Small tables with repeated and missing keys, lines of equal keys and missing amounts."""
    path = str(path)
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        shutil.copyfile(f"{SF_SMALL}/{name}.parquet", f"{path}/{name}.parquet")
    lines = pq.read_table(f"{path}/lineitem.parquet").slice(0, 600)
    n = pa.array(range(len(lines)))

    def some(name, every, value=None):
        at = lines.schema.get_field_index(name)
        hit = pc.equal(pc.subtract(n, pc.multiply(pc.divide(n, every), every)), 0)
        kind = lines.schema.field(name).type
        return lines.set_column(at, name, pc.if_else(hit, pa.scalar(value, kind), lines[name].combine_chunks()))

    lines = some("l_quantity", 7)
    lines = some("l_extendedprice", 11)
    lines = some("l_partkey", 13)
    lines = some("l_partkey", 3, 5)
    lines = some("l_suppkey", 17)
    lines = some("l_shipdate", 5, dt.datetime(1999, 1, 1))
    pq.write_table(pa.concat_tables([lines, lines.slice(0, 40)]), f"{path}/lineitem.parquet")
    for name, rows in (("nation", 2), ("customer", 30), ("part", 20), ("orders", 50)):
        table = pq.read_table(f"{path}/{name}.parquet")
        pq.write_table(pa.concat_tables([table, table.slice(0, rows)]), f"{path}/{name}.parquet")
    return path


def test_lines_are_dealt_by_product_where_products_are_broadcast(spark):
    for name in ("demand_daily", "demand_features"):
        found = line_shuffles(all_queries()[name].build(spark, SF_SMALL))
        assert found and not any("order_date" in keys for keys in found)


def test_daily_demand_of_odd_tables_is_that_of_the_plain_master(spark, tmp_path):
    path = odd_tables(tmp_path)
    raw = raw_tables(spark, path)
    plain = feat.demand_daily(build_master(raw.products, raw.customers, raw.orders))
    found = all_queries()["demand_daily"].build(spark, path)
    assert plain.count() > 200
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()


def test_curated_master_writes_what_the_line_key_repeats_once(spark, tmp_path):
    path = odd_tables(tmp_path)
    raw = raw_tables(spark, path)
    plain = build_master(raw.products, raw.customers, raw.orders).select(*MASTER_COLUMNS, "line_key")
    found = artifacts.curated_master(spark, path)
    assert found.schema["line_key"].dataType.simpleString() == plain.schema["line_key"].dataType.simpleString()
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    assert found.where(F.col("line_key.k6").isNull()).count() > 10
    files = artifacts.shared_path(spark, path, "master")
    assert "line_key" not in spark.read.parquet(files).columns
    assert any(f.endswith(".zstd.parquet") for f in os.listdir(files.removeprefix("file:")))


def test_customers_of_the_segments_are_aggregated_once(spark, tmp_path, monkeypatch):
    plans = []
    fit = artifacts.CM.fit

    def seen(customers, **more):
        plans.append(customers._jdf.queryExecution().executedPlan().toString())
        return fit(customers, **more)

    monkeypatch.setattr(artifacts.CM, "fit", seen)
    artifacts.segment_artifact(spark, odd_tables(tmp_path))
    assert len(plans) == 1 and "Aggregate" not in plans[0]
