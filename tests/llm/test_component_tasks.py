from ledgerline.llm import components as C


def test_rounds_over_few_edges_run_in_few_tasks(spark, monkeypatch):
    tasks = []

    def kept(df, real=C.checkpointed):
        out = real(df)
        tasks.append(out.rdd.getNumPartitions())
        return out

    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    monkeypatch.setattr(C, "checkpointed", kept)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        pairs = [(i, i + 1) for i in range(1, 40) if i % 10] + [(5, 5), (None, 7), (2, 1)]
        found = {r.node: r.component for r in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 41)}
    assert len(tasks) > 2 and set(tasks[1:]) == {1}
