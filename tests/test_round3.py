"""One small test per finding of the third round."""
import glob

from ledgerline.operators import features as feat
from ledgerline.operators.master import build_master
from ledgerline.sources import io as IO


def raw(spark):
    orders = spark.createDataFrame(
        [(i, i % 3, i % 2, f"2024-01-{1 + i % 9:02d}", 1.0 + i, 2.0) for i in range(40)],
        "order_id long, product_id long, customer_id long, order_date string, quantity double, price double")
    orders = orders.withColumn("order_date", orders.order_date.cast("timestamp"))
    products = spark.createDataFrame([(i, f"p{i}", "long text " * 50) for i in range(3)],
                                     "product_id long, product_name string, product_description string")
    customers = spark.createDataFrame([(i, "seg") for i in range(2)], "customer_id long, segment string")
    return products, customers, orders


def test_report_export_is_compressed_and_whole(spark):
    """F1"""
    master = build_master(*raw(spark))
    src, out = IO.unique_scratch(spark, "wide"), IO.unique_scratch(spark, "report")
    IO.write_curated(master, src)
    IO.export_report_csv(spark, src, out)
    assert glob.glob(f"{out}/*.csv.gz") and not glob.glob(f"{out}/*.csv")
    back = IO.load_csv(spark, out)
    assert back.columns == master.columns and back.count() == 40
    assert {r.product_description.strip() for r in back.collect()} == {("long text " * 50).strip()}


def test_lines_are_not_shuffled_after_the_products_join(spark):
    """Long product texts travel once, demand reuses the join's distribution."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = feat.demand_features(build_master(*raw(spark)))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert plan.index("SortMergeJoin") < plan.index("Exchange")


def test_the_curated_master_holds_the_master_columns(spark):
    """the reports' table carries no text that only the export needs."""
    from conftest import SF_SMALL
    from ledgerline.operators.master import MASTER_COLUMNS
    from ledgerline.plans.artifacts import curated_master, whole_master
    assert curated_master(spark, SF_SMALL).columns == [*MASTER_COLUMNS, "line_key"]
    whole = IO.read_curated(spark, whole_master(spark, SF_SMALL))
    assert {*MASTER_COLUMNS, "line_key", "product_description", "return_policy", "location"} <= set(whole.columns)


def test_scores_are_those_of_a_plain_walk_and_read_from_a_table(spark):
    """F11, F12, F14, F20"""
    import numpy as np
    from ledgerline.models import isoforest as IF
    df = spark.range(600).selectExpr("id", "cast(pmod(id * 37, 101) as double) a", "cast(pmod(id, 7) as double) b").repartition(4)
    model, flagged = IF.fit(df, ["a", "b"], key=["id"], n_trees=9, partitions=2)
    assert "FileScan parquet" in flagged._jdf.queryExecution().executedPlan().toString()
    nodes = {(r.tree, r.node): r for r in model.nodes.itertuples()}
    for r in flagged.collect():
        x, depths = (r.a, r.b), []
        for t in range(9):
            n, depth = nodes[t, 0], 0
            while n.left >= 0:
                n, depth = nodes[t, n.left if x[n.feature] < n.threshold else n.right], depth + 1
            depths.append(depth + float(IF.c_factor([n.size])[0]))
        assert abs(r.anomaly_score + 2 ** (-np.mean(depths) / float(IF.c_factor([model.psi])[0]))) < 1e-12


def test_a_stream_source_file_is_dealt_in_groups(spark):
    """the rows of one file can be scored by several tasks."""
    import pyarrow.parquet as pq
    from ledgerline.streaming.scoring import SOURCE_GROUP
    path = IO.unique_scratch(spark, "groups")
    spark.range(0, 2_000_000, numPartitions=1).selectExpr("uuid() AS v").write.option("parquet.block.size", SOURCE_GROUP).parquet(path)
    (file,) = glob.glob(f"{path}/*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 4


def test_table_of_sums_offers_the_same_splits(tmp_path):
    """A dense level is compared as a table, with the splits of the listed cells."""
    import numpy as np
    from ledgerline.models.hist_forest import _Best
    rng = np.random.RandomState(5)
    cw = rng.randint(0, 4, (50, 8)).astype(float)
    cw[:, 0] += 1
    cs = np.where(cw > 0, rng.randint(0, 9, cw.shape), 0).astype(float)
    listed, table = (_Best(cw.sum(axis=1), cs.sum(axis=1), 2) for _ in range(2))
    key = np.flatnonzero(cw)
    listed.offer(3, key, 8, cw.ravel()[key], cs.ravel()[key], ordered=True)
    table.offer_table(3, cw, cs)
    for name in ("gain", "feature", "threshold"):
        assert getattr(listed, name).tolist() == getattr(table, name).tolist()
