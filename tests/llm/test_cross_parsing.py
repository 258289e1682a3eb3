"""Language identification against a plain greedy parse, and held-out accuracy."""
import math
import random
import re

import numpy as np

from conftest import SF_ORACLE
from ledgerline.llm import cross_parsing as C
from ledgerline.llm import queries


def plain_phrases(text, sample, block):
    n = 0
    for a in range(0, len(text), block):
        piece = text[a:a + block]
        while piece:
            k = 0
            while k < len(piece) and piece[:k + 1] in sample:
                k += 1
            piece, n = piece[max(1, k):], n + 1
    return n


def plain_bytes(text):
    return re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", (text or "").lower().encode() + b"\n")


def test_phrases_match_a_greedy_parse():
    rng = random.Random(4)
    for alphabet, foreign in [("ab", "c"), ("abcd ", "é"), ("xyz", "")]:
        samples = ["".join(rng.choices(alphabet, k=rng.randint(1, 120))).encode() for _ in range(3)]
        parser = C.Parser.of(samples)
        texts = ["".join(rng.choices(alphabet + foreign, k=rng.randint(1, 90))).encode() for _ in range(60)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts])
        got = parser.phrases(data, np.cumsum(lengths) - lengths, lengths)
        assert got.tolist() == [[plain_phrases(t, s, 1000) for s in samples] for t in texts]


def test_squeezed_texts():
    texts = ["Ab  c%%", "", "\n\n", "é, x"]
    buf = np.frombuffer(b"".join(t.encode() + b"\n" for t in texts), np.uint8)
    off = np.cumsum([0] + [len(t.encode()) + 1 for t in texts])
    data, ends = C.squeezed(buf, off)
    # capitals are separators here: Spark lowers the text before
    assert [bytes(data[a:b]) for a, b in zip(ends, ends[1:])] == \
        [re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", t.encode() + b"\n") for t in texts]


ROWS = [(1, "The cat and the dog. " * 3, "en"), (2, "Der Hund und die Katze. " * 3, "de"), (3, "the old house", "en"),
        (4, "das alte Haus", "de"), (5, None, "en"), (6, "", "de"), (7, "12 %% !", "en"), (8, "the dog", None),
        (9, "und die", None), (10, "日本語", None), (10, "日本語", None), (None, "der Hund", "xx"), (11, "Ünd die É", None)]


def test_whole_rule_on_a_small_table(spark):
    df = spark.createDataFrame([(*r, "x", 0.5) for r in ROWS],
                               "doc_id long, text string, lang string, lang_pred string, score double")
    labelled = df.where("doc_id < 8")
    for block in (2048, 5):
        got = {r.doc_id: r for r in C.identify(df, labelled, block=block).collect()}
        samples = dict(C.samples(labelled, "text", "lang", 256, 1 << 17))
        assert sorted(samples) == ["de", "en"]
        for doc, text, _ in ROWS:
            r = got[doc]
            if not any(c.isalpha() for c in text or ""):
                assert (r.lang_pred, r.score) == ("und", 0.0)
                continue
            cost = {x: plain_phrases(plain_bytes(text), s, block) * math.log2(len(s)) for x, s in samples.items()}
            assert abs(r.bits - min(cost.values())) < 1e-9 and abs(cost[r.lang_pred] - r.bits) < 1e-9
            assert abs(r.score - (1 - min(cost.values()) / max(cost.values()))) < 1e-9
    assert got[8].lang_pred == "en" and got[9].lang_pred == "de"
    assert C.identify(df, labelled).count() == len(ROWS)


def test_nothing_learned_one_language_and_empty_tables(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in C.identify(df, df.limit(0)).collect()} == {"und"}
    one = {r.doc_id: r for r in C.identify(df, df.where("lang = 'de'")).collect()}
    assert (one[1].lang_pred, one[1].score, one[7].lang_pred) == ("de", 1.0, "und")
    assert C.identify(df.limit(0), df).count() == 0


def test_fit_is_bounded_and_counts_copies_once(spark):
    rows = [(i, "copy of a text", "en") for i in range(200)] + [(i, f"text {'abcdefg'[i % 7] * 40}", "en") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    (_, sample), = C.samples(df, "text", "lang", 256, 1 << 17)
    assert len(sample) < 8 * 60 and sample.count(b"copy") == 1
    (_, sample), = C.samples(df, "text", "lang", 4, 64)
    assert len(sample) <= 64


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op11_language_id"](spark, SF_ORACLE)
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
