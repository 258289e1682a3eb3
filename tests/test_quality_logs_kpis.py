import pytest
import datetime as dt

from pyspark.sql import functions as F

from ledgerline.operators import kpis as K
from ledgerline.operators import quality as QL
from ledgerline.operators.cleaning import clean_orders, keep_first
from ledgerline.sources import logs as LG


def test_quarantine_rules(spark):
    df = spark.createDataFrame(
        [(1, "2", "10", "0", "1"), (2, "-1", "10", "0", "0"), (3, "x", "0", "-5", "3"),
         (4, None, None, None, None)],
        "id int, quantity string, price string, discount_pct string, promotion_flag string")
    out = {r["id"]: r for r in QL.quarantine(df).collect()}
    assert out[1]["is_valid"] and out[1]["errors"] == []
    assert out[2]["errors"] == [QL.MSG_QUANTITY]
    assert out[3]["errors"] == [QL.MSG_QUANTITY, QL.MSG_PRICE, QL.MSG_DISCOUNT, QL.MSG_PROMOTION]
    assert out[4]["errors"] == [QL.MSG_QUANTITY, QL.MSG_PRICE]


def test_required_arguments(spark):
    df = spark.createDataFrame([("P1", ""), (None, "2025-01-01")], "product_id string, forecast_date string")
    out = QL.quarantine(df, required=["product_id", "forecast_date", "missing_col"],
                        transaction_rules=False).collect()
    assert out[0]["errors"] == ["missing required argument: forecast_date",
                                "missing required argument: missing_col"]
    assert out[1]["errors"][0] == "missing required argument: product_id"


def test_upsert_update_insert_two_updates(spark):
    ex = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    up = spark.createDataFrame([("a", 10, 1), ("a", 11, 2), ("c", 30, 1)], "k string, v int, seq int")
    out = {r["k"]: r for r in LG.upsert(ex, up.drop("seq").withColumn("seq", F.col("v")),
                                        ["k"], ["seq"]).collect()}
    assert out["a"]["v"] == 11 and out["b"]["v"] == 2 and out["c"]["v"] == 30
    assert out["b"]["updated_at"] is None and out["a"]["updated_at"] is not None


def test_recent_per_collection(spark):
    base = dt.datetime(2025, 1, 1)
    rows = [("x", i, base + dt.timedelta(minutes=i)) for i in range(30)] + \
           [("y", 100 + i, base + dt.timedelta(minutes=i)) for i in range(3)]
    df = spark.createDataFrame(rows, "coll string, id int, created_at timestamp")
    r = LG.recent(df, 5, per=["coll"], tiebreak=["id"]).collect()
    assert len([x for x in r if x["coll"] == "x"]) == 5 and len([x for x in r if x["coll"] == "y"]) == 3
    top = LG.recent(df, 2, tiebreak=["id"]).collect()
    assert [x["id"] for x in top] == [29, 28]


def test_keep_first_and_clean_orders(spark):
    df = spark.createDataFrame(
        [("O1", "P", "C", "3", "2025-01-01", 2), ("O1", "P", "C", "5", "2025-01-01", 1),
         ("O2", None, "C", "0", "2025-01-01", 3), ("O3", "P", "C", "x", "bad", 4),
         ("O4", "P", "C", None, "2025-01-02", 5)],
        "order_id string, product_id string, customer_id string, quantity string, "
        "order_date string, line_key int")
    out = {r["order_id"]: r for r in clean_orders(df).collect()}
    assert set(out) == {"O1", "O4"}                  # O2 zero qty, O3 bad date
    assert out["O1"]["quantity"] == 5.0               # first by line_key
    assert out["O4"]["quantity"] == 1.0               # null quantity -> 1
    k = keep_first(spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "k int, v string, o int"),
                   "k", F.col("o")).first()
    assert k["v"] == "a"
    for rows in ([(1, "b", 1), (1, "a", 1)], [(1, "a", 1), (1, "b", 1)]):   # ties: by the row, not by its place
        tied = keep_first(spark.createDataFrame(rows, "k int, v string, o int"), "k", F.col("o")).first()
        assert tied["v"] == "a"
    with pytest.raises(ValueError):
        clean_orders(df.drop("line_key"))


def test_classification_metrics_edges(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (None, 0)], "y int, p int")
    r = K.classification_metrics(df, "y", "p").first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1_score"] == 0.0
    assert abs(r["accuracy"] - 0.6667) < 1e-9
    allnull = spark.createDataFrame([(None, 1)], "y int, p int")
    r2 = K.classification_metrics(allnull, "y", "p").first()
    assert r2["fp"] == 1 and r2["accuracy"] == 0.0


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "y double, p double")
    r = K.regression_metrics(df, "y", "p").first()
    assert r["mae"] == 0.3333 and r["mse"] == 0.3333 and r["r2_score"] == 0.5


def test_kpis_and_top(spark):
    df = spark.createDataFrame(
        [("O1", "P1", "C1", "a", 10.005), ("O1", "P2", "C1", "b", 20.0), ("O2", "P1", "C2", "b", 5.0)],
        "order_id string, product_id string, customer_id string, category string, total_amount double")
    r = K.kpis(df).first()
    assert (r["total_orders"], r["total_products"], r["total_customers"]) == (2, 2, 2)
    top = K.top_categories(df, 1).collect()
    assert top[0]["category"] == "b" and top[0]["revenue"] == 25.0
    m = K.top_categories_map(df, 5).first()["top_categories"]
    assert set(m) == {"a", "b"}


def test_upsert_table_rewrites_only_the_parts_of_its_keys(spark):
    import os
    from ledgerline.sources import io as IO
    path = IO.unique_scratch(spark, "test-keyed")
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(200)] + [(None, "n")], "k long, v string")
    LG.write_keyed(rows, path, ["k"], parts=16)

    def files():
        return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith(LG.PART)}

    before = files()
    updates = spark.createDataFrame([(7, "old", 1), (7, "new", 2), (500, "added", 1), (8, "eight", 1)], "k int, v string, at int")
    stamp = F.lit("2025-01-01").cast("timestamp")
    written = LG.upsert_table(spark, path, updates, ["k"], ["at"], updated_at=stamp)
    after = files()
    got = {r.k: r.v for r in LG.read_keyed(spark, path).collect()}
    want = {i: f"v{i}" for i in range(200)} | {None: "n", 7: "new", 500: "added", 8: "eight"}
    assert got == want and LG.read_keyed(spark, path).count() == 202
    assert written <= 3 and len(before) > 10
    assert sum(before[d] != after[d] for d in before) <= 3
    # the same batch again changes nothing; no updates rewrite nothing
    LG.upsert_table(spark, path, updates, ["k"], ["at"], updated_at=stamp)
    assert {r.k: r.v for r in LG.read_keyed(spark, path).collect()} == want
    assert LG.upsert_table(spark, path, updates.limit(0), ["k"], ["at"]) == 0


def test_dashboard_takes_metrics_of_several_models(spark):
    from ledgerline.operators import dashboard as DB

    master = spark.createDataFrame([(1, 2, 3, 10.0, "a"), (2, 2, 4, 5.0, None)],
                                   "order_id int, product_id int, customer_id int, total_amount double, category string")
    one = spark.createDataFrame([(0.5,)], "r2 double")
    two = spark.createDataFrame([(3, "x")], "n_clusters int, category string")  # a clashing name stays inside
    row = DB.dashboard(master, model_metrics={"demand": one, "clusters": two}).collect()
    assert len(row) == 1 and row[0].model_metrics.demand.r2 == 0.5 and row[0].model_metrics.clusters.category == "x"
    assert row[0].total_orders == 2 and row[0].top_categories == {"a": 10.0}
    assert DB.dashboard(master, model_metrics=one).first().model_metrics.r2 == 0.5
    assert "model_metrics" not in DB.dashboard(master).columns


def test_support_prompts_only_for_questions_with_hits(spark):
    from ledgerline.operators import dashboard as DB

    answers = spark.createDataFrame([(1, "Why?", "Source 1:\nx", None), (2, "How?", "", "No hits")],
                                    "q int, question string, context string, retrieval_error string")
    got = DB.support_prompts(answers, ["q"]).collect()
    assert [r.q for r in got] == [1]
    assert got[0].user_prompt == ("Customer Question:\nWhy?\n\nRetrieved Context:\nSource 1:\nx\n\n"
                                  "Answer briefly using only the retrieved context.\nMention product id if relevant.")
