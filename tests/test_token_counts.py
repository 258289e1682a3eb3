import hashlib

from pyspark.sql import functions as F

from ledgerline.functions.vectors import bucket_counts, hash_embedding, token_buckets


def test_token_counts_are_those_of_the_buckets(spark):
    texts = ["One two two, THREE 3 äß İstanbul 한국어 \U0001d7d8", "", None, " ,; ", "two"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    for dim in (1, 7, 256):
        rows = df.select("t", hash_embedding("t", dim).alias("new"),
                         bucket_counts(token_buckets("t", dim), dim).alias("old")).collect()
        assert len(rows) == len(texts)
        assert all(r.new == r.old and len(r.new) == dim for r in rows)
    at = int(hashlib.md5(b"two").hexdigest()[:8], 16) % 256
    assert df.where("i = 4").select(hash_embedding("t")[at]).first()[0] == 1.0


def test_embedding_hashes_no_occurrence_in_the_plan(spark):
    df = spark.createDataFrame([("a b a",)], "t string")
    plan = df.select(hash_embedding("t").alias("e"))._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan


def test_the_store_is_chunked_by_all_cores(spark):
    from conftest import SF_SMALL
    from ledgerline.adapter import products_table
    from ledgerline.operators.retrieval import product_chunks

    plain, spread = products_table(spark, SF_SMALL), products_table(spark, SF_SMALL, spread=True)
    assert plain.exceptAll(spread).isEmpty() and spread.exceptAll(plain).isEmpty()
    assert product_chunks(spread).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
