"""Plan-shape checks for scale properties (no execution needed)."""
from conftest import SF_SMALL

import __spark_entry__ as E


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_partition_or_cross_products(spark):
    for name in ["demand_features", "customer_features", "category_distribution", "kpis",
                 "vector_search", "embedding_search", "cosine", "upsert", "recent_logs",
                 "latest_by_product", "clean_orders"]:
        p = _plan(spark, name)
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name
    # global aggregates legitimately end in one partition (one partial row
    # per task); what must not appear is a window over everything
    assert "Window" not in _plan(spark, "category_distribution")


def test_search_and_recent_use_group_limits(spark):
    assert "WindowGroupLimit" in _plan(spark, "vector_search")
    assert "WindowGroupLimit" in _plan(spark, "recent_logs")
    assert "TakeOrderedAndProject" in _plan(spark, "top_categories")


def test_scans_prune_and_push(spark):
    df = E.queries()["vector_search"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,user)" in p
    # the master's lineitem scan reads only the columns it needs
    from ledgerline.adapter import orders_table
    m = orders_table(spark, SF_SMALL).select("order_id", "quantity")._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" in m and "l_tax" not in m and "l_shipdate" not in m


def test_reports_scan_the_curated_master_once(spark):
    for name in ["kpis", "monthly_revenue", "revenue_ytd", "top_categories", "customers_by_segment_region",
                 "anomaly_label_rate"]:
        p = _plan(spark, name)
        assert "Join" not in p, name
        assert p.count("FileScan") == 1, name
