"""Corpus pipeline: toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet in the shared folder and read again as
the next one's docs.  All stages but the last return the columns of documents.

* toxicity: a classifier is fitted on the labelled documents; documents scored
  at 0.7 or more go.
* ngram_jaccard_join: documents whose five-word shingles reach a Jaccard
  similarity of 0.8 are linked; the least doc_id of every component stays.
* suffix_array_dedup: every byte covered by a 200-byte string that stands
  elsewhere too is cut from its text (n_chars follows); documents stay.
* best_fit_packing: what is left is tokenised and packed into sequences.

Edge cases: null texts pass the filters as empty texts; rows with a null
doc_id are never duplicates of others; of exactly repeated rows one stays in
the second stage; extra columns pass through; empty tables give empty results.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import jaccard_join, packing, suffix_dedup, toxicity
from ledgerline.session import checkpointed, ensure_checkpoint_dir

TOXIC_FROM = 0.7
SHINGLE_WORDS = 5
SIMILARITY = (4, 5)
REPEATED_BYTES = 200
SEQUENCE_TOKENS = 4096


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.reject(docs, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.join(docs, width=SHINGLE_WORDS, threshold=SIMILARITY).where("doc_id is not null")
    by_id = checkpointed(found.groupBy("doc_id").agg(
        F.max(F.col("component_id") == F.col("doc_id")).alias("stays"), F.count("*").alias("rows")))
    kept = docs.join(by_id.where("not stays").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    again = by_id.where("stays and rows > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates()
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c != "text"]
    cut = suffix_dedup.dedup(docs, min_length=REPEATED_BYTES, with_text=True, carry=others)
    out = cut.select("text", "row.*")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=SEQUENCE_TOKENS)
    return packing.pack(checkpointed(pieces), max_tokens=SEQUENCE_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

# token ids, a fitted classifier and byte suffixes are beyond SQL; tests hold
# the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
