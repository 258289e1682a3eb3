"""The pipeline's stages and the registered digests on the smallest tables."""
import random

import duckdb

from conftest import SF_SMALL

import __spark_entry__ as E
import corpus_pipeline
from ledgerline.llm import queries


def corpus(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    near = prose(200).split()
    changed = list(near)
    changed[100] = "other"
    rows = [(i, prose(80) + (" you stupid idiot scum" if i % 6 == 0 else "")) for i in range(90)]
    rows += [(200, " ".join(near)), (201, " ".join(changed)), (202, " ".join(near)), (300, prose(40) + " " + passage + " " + prose(40)),
             (301, prose(30) + " " + passage + " " + prose(50)), (400, None), (401, ""), (500, "solo words"), (500, "solo words")]
    rows = [(d, t, "en", "s", len(t or ""), 5) for d, t in rows] + [(None, prose(20), None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    labels = [(i, int(i % 6 == 0)) for i in range(90)]
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), passage


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    docs, labels, passage = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark_docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, spark_docs, str(tmp_path)).cache()
    ids = lambda df: sorted((r.doc_id is not None, r.doc_id) for r in df.select("doc_id").collect())
    want = [d for d in (r.doc_id for r in docs.collect()) if d is None or not (d < 90 and d % 6 == 0)]
    assert ids(clean) == sorted((d is not None, d) for d in want) and clean.columns == docs.columns
    unique = stages["ngram_jaccard_join"](spark, clean, str(tmp_path)).cache()
    kept = list(want)
    for d in (201, 202, 500):
        kept.remove(d)
    assert ids(unique) == sorted((d is not None, d) for d in kept) and unique.columns == docs.columns
    cut = stages["suffix_array_dedup"](spark, unique, str(tmp_path)).cache()
    assert ids(cut) == ids(unique) and cut.columns == docs.columns
    texts = {r.doc_id: r for r in cut.collect()}
    before = {r.doc_id: r for r in unique.collect()}
    assert passage not in texts[300].text and passage not in texts[301].text
    assert texts[300].n_chars == len(texts[300].text) < before[300].n_chars
    assert all(texts[d].text == before[d].text for d in texts if d not in (300, 301, 400))
    packed = stages["best_fit_packing"](spark, cut, str(tmp_path))
    assert ids(packed) == ids(cut)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == len(kept)


def test_pipeline_on_empty_tables(spark, tmp_path):
    docs, labels, _ = corpus(spark)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered_once_each():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(queries.ORACLES) <= set(queries.QUERIES)


def test_norm_search_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_SMALL}/embeddings.parquet')")
    got = sorted(tuple(r) for r in queries.QUERIES["op4_norm_sorted_topk"](spark, SF_SMALL).collect())
    assert got == sorted(con.execute(queries.ORACLES["op4_norm_sorted_topk"]).fetchall())
