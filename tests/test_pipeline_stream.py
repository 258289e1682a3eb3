import os
import tempfile

from conftest import SF_SMALL

from ledgerline.adapter import customers_table, orders_table, products_table
from ledgerline.models import demand as DM
from ledgerline.operators.features import anomaly_features
from ledgerline.operators.master import master_from_sf
from ledgerline.models import isoforest as IF
from ledgerline.plans.training import train_all
from ledgerline.sources import io as IO
from ledgerline.streaming.scoring import StreamPaths, run_available_now


def test_training_run_summary(spark):
    out = IO.unique_scratch(spark, "test-training")
    s = train_all(spark, products_table(spark, SF_SMALL), customers_table(spark, SF_SMALL),
                  orders_table(spark, SF_SMALL), out, DM.DemandConfig(num_trees=5, max_depth=4),
                  forest_trees=20, kmeans_restarts=2).first()
    assert s["rows_master"] > 0 and s["rows_demand"] > 0
    m = s["metrics"]
    assert m["customer_clustering"]["n_clusters"] == 3
    assert abs(m["anomaly_detection"]["anomaly_rate"] - 0.05) < 0.02
    assert m["demand_forecasting"]["rows_train"] > 0
    # S5 source: the metrics sub-record reads back
    back = IO.read_metrics(spark, f"{out}/metrics/training_metrics",
                           spark.read.json(f"{out}/metrics/training_metrics").schema)
    assert "demand_forecasting" in back.columns
    # The forest round-trips
    f = IF.IsolationForestModel.load(spark, f"{out}/models/anomaly_model")
    dm, modes = DM.load(spark, f"{out}/models/demand_model")
    assert set(modes) == set(DM.DEMAND_CATEGORICAL)
    assert f.threshold is not None and len(f.nodes) > 0


def test_stream_scoring_and_quarantine(spark):
    m = master_from_sf(spark, SF_SMALL)
    model, _ = IF.fit(anomaly_features(m), ["quantity", "price", "total_amount", "unit_price",
                                             "discount_pct", "promotion_flag"],
                      key=["order_id", "product_id", "quantity"], n_trees=20)
    base = IO.unique_scratch(spark, "test-stream")
    paths = StreamPaths(f"{base}/src", f"{base}/out", f"{base}/bad", f"{base}/ckpt")
    good = spark.createDataFrame([("a", 2.0, 10.0, 0.0, 0), ("b", 80.0, 1500.0, 0.0, 0)],
                                 "order_id string, quantity double, price double, "
                                 "discount_pct double, promotion_flag int")
    bad = spark.createDataFrame([("c", -1.0, 10.0, 0.0, 0)], good.schema)
    good.union(bad).write.mode("append").parquet(paths.source)
    run_available_now(spark, model, paths)
    out = spark.read.parquet(paths.scored).collect()
    assert sorted(r["order_id"] for r in out) == ["a", "b"]
    assert all(r["created_at"] is not None for r in out)
    q = spark.read.parquet(paths.quarantined).collect()
    assert [r["order_id"] for r in q] == ["c"]
    # a second batch is picked up incrementally (exactly once)
    spark.createDataFrame([("d", 1.0, 5.0, 0.0, 1)], good.schema).write.mode("append") \
        .parquet(paths.source)
    run_available_now(spark, model, paths)
    assert sorted(r["order_id"] for r in spark.read.parquet(paths.scored).collect()) == ["a", "b", "d"]


def test_a_batch_that_failed_between_its_sinks_is_replayed_without_doubles(spark, monkeypatch):
    import pytest
    from ledgerline.streaming import scoring
    m = master_from_sf(spark, SF_SMALL)
    model, _ = IF.fit(anomaly_features(m), ["quantity", "price", "total_amount", "unit_price",
                                             "discount_pct", "promotion_flag"],
                      key=["order_id", "product_id", "quantity"], n_trees=10)
    base = IO.unique_scratch(spark, "test-stream-replay")
    paths = StreamPaths(f"{base}/src", f"{base}/out", f"{base}/bad", f"{base}/ckpt")
    rows = spark.createDataFrame([(f"t{i}", float(i % 4), 10.0, 0.0, 0) for i in range(40)],
                                 "order_id string, quantity double, price double, discount_pct double, promotion_flag int")
    rows.repartition(4).write.parquet(paths.source)
    plain = scoring.to_sink

    def fails_once(df, path, batch_id):
        if path == paths.quarantined and batch_id == 1:
            raise RuntimeError("lost between the two sinks")
        plain(df, path, batch_id)

    monkeypatch.setattr(scoring, "to_sink", fails_once)
    with pytest.raises(Exception):
        run_available_now(spark, model, paths, max_files_per_trigger=2)
    half = spark.read.parquet(paths.scored).count()
    assert half > spark.read.parquet(paths.quarantined).where("batch_id = 0").count()
    monkeypatch.setattr(scoring, "to_sink", plain)
    run_available_now(spark, model, paths, max_files_per_trigger=2)
    scored = [r.order_id for r in spark.read.parquet(paths.scored).collect()]
    bad = [r.order_id for r in spark.read.parquet(paths.quarantined).collect()]
    assert sorted(scored) == sorted(f"t{i}" for i in range(40) if i % 4)
    assert sorted(bad) == sorted(f"t{i}" for i in range(0, 40, 4))


def test_demand_model_roundtrip_and_missing(spark):
    import pytest
    from ledgerline.sources.io import ModelNotFoundError
    with pytest.raises(ModelNotFoundError):
        DM.load(spark, IO.unique_scratch(spark, "no-model"))
