"""How often the order lines are moved on their way to the master and to the demand."""

from contextlib import contextmanager

from conftest import SF_SMALL
from pyspark.sql import functions as F

from ledgerline.adapter import raw_tables
from ledgerline.models import demand as DM
from ledgerline.operators.master import build_master, master_from_sf
from ledgerline.plans.registry import all_queries


@contextmanager
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def line_shuffles(df):
    """The exchanges by key that order lines go through."""
    rows = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(r) - len(r.lstrip(" :+-*()0123456789")) for r in rows]
    out = []
    for i, row in enumerate(rows):
        if "Exchange hashpartitioning(" in row:
            below = []
            for j in range(i + 1, len(rows)):
                if depth[j] <= depth[i]:
                    break
                below.append(rows[j])
            if any("FileScan" in b and "l_partkey" in b for b in below):
                out.append(row.split("hashpartitioning(")[1].split(")")[0])
    return out


def test_no_line_is_shuffled_by_customer(spark):
    with no_broadcast(spark):
        found = line_shuffles(master_from_sf(spark, SF_SMALL))
    # by order, supplier (broadcast where small) and product
    assert len(found) == 3
    assert not any("custkey" in keys or "customer" in keys for keys in found)


def test_master_is_the_join_of_the_adapters_tables(spark):
    raw = raw_tables(spark, SF_SMALL)
    plain = build_master(raw.products, raw.customers, raw.orders)
    found = master_from_sf(spark, SF_SMALL)
    assert found.schema == plain.schema
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()


def test_forecast_inputs_move_lines_by_product_once(spark):
    with no_broadcast(spark):
        found = line_shuffles(all_queries()["forecast_inputs"].build(spark, SF_SMALL))
    assert not any("order_date" in keys for keys in found)


def test_small_position_tables_travel_to_the_rows(spark):
    values = [(f"p{i}", *"abcdef") for i in range(4)]
    rows = spark.createDataFrame(values, ", ".join(f"{c} string" for c in DM.DEMAND_CATEGORICAL))
    rows = rows.select("*", *(F.lit(1.0).alias(c) for c in DM.DEMAND_NUMERIC))
    index, widths = DM.category_index(rows)
    wide = widths | {"product_id": DM.SMALL_INDEX + 1}
    with no_broadcast(spark):
        out = DM.encoded(rows, DM.Encoding(index, wide, {c: 0.0 for c in DM.DEMAND_NUMERIC}, {}))
        plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") >= 6
    assert sorted(r["__pos"][0] for r in out.collect()) == [0, 1, 2, 3]
