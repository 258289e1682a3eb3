"""Per-document operators against plain statements of their rules."""
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from ledgerline.llm import arrays as A
from ledgerline.llm import byte_bpe, license_scan, maxent_lm, packing, toxicity

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n", "\n\n", "a\n", "\na", "a  b \n\n c   x", "\u00a0\u3000 \n hi", "x\x1cy  z   ",
       "it's 12 3x!!  \n", "日本語 テスト" * 30, "a" * 3000, "漢   b", "Éa É", "a\u0301 b", "it's it's", "<|endoftext|> x"]


def noise(n, alphabet, longest, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def frame(spark, texts):
    """Repeated rows, a null id, and extra columns that clash with results."""
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1), (None, "null id", "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words int")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def test_slices_keep_texts_apart_and_whole():
    texts = ["ab", None, "", "x" * 50, "é y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["doc_id", "text"])
    got = []
    for rows, buf, off in A.slices(iter([batch]), "text", max_bytes=8):
        got += [bytes(buf[a:b - 1]).decode() for a, b in zip(off, off[1:])]
        assert len(rows) == len(off) - 1
    assert got == [t or "" for t in texts]


def test_span_hashes_depend_on_content_only():
    buf = np.frombuffer(b"abc xabc abd abc", np.uint8)
    s, e = np.array([0, 5, 9, 13]), np.array([3, 8, 12, 16])
    h = A.span_hashes(buf, s, e)
    assert h[0] == h[1] == h[3] != h[2]
    assert h[0] == A.hash_of(b"abc")


def test_byte_bpe_matches_tiktoken_and_round_trips(spark):
    texts = ODD + noise(300, list(" \n\t\u00a0\u3000ab1!é'sñ\x1c "), 60)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    got = byte_bpe.encode(frame(spark, texts), RANKS, P.PATTERN, with_ids=True).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "null id" if r.doc_id is None else texts[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    coder = byte_bpe.ByteBpe(RANKS, P.PATTERN)
    assert coder.decode(coder.encode("Grüße, 12!".encode())) == "Grüße, 12!".encode()
    assert byte_bpe.encode(frame(spark, texts).limit(0), RANKS, P.PATTERN).count() == 0


def test_span_table_starts_afresh_beyond_its_limit():
    table = A.SpanTable(lambda spans: [A.Ragged.of(spans)], limit=4)
    for text in (b"a b c a", b"d e f a", b"a b c d e f g"):
        buf = np.frombuffer(text, np.uint8)
        s, e = A.word_spans(buf, A.byte_mask(A.BLANKS))
        which, (column,) = table.find(buf, s, e)
        assert column.take(which).flat.tobytes() == text.replace(b" ", b"")


def test_pieces_match_the_tokenizer_and_fill_sequences(spark):
    texts = ODD + noise(60, list("abcdef gh'sé1!\n"), 400) + ["word " * 300]
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    pieces = packing.tokenise(frame(spark, texts), WORDS, max_tokens=64, with_ids=True)
    got = packing.pack(pieces, max_tokens=64, group_pieces=40).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, text in enumerate(texts):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want = [(k // 64, k, len(ids[k:k + 64]), zlib.crc32(ids[k:k + 64].tobytes())) for k in range(0, len(ids), 64)]
        rows = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d])
        assert rows == sorted(want * (2 if d == 0 else 1))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.tokenise(frame(spark, texts).limit(0), WORDS)).count() == 0


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = -np.sort(-np.random.default_rng(0).integers(1, 101, 500))
    bins, offsets = packing.best_fit(lengths, (100.0, 4.0, 6000.0), (1.0, 0.3, 0.5), rule)
    for b in set(bins.tolist()):
        mine = lengths[bins == b]
        assert mine.sum() <= 100 and len(mine) <= 4
        assert (mine ** 2).sum() <= 6000 or len(mine) == 1
    assert packing.best_fit(np.array([6, 4]), (10.0, 10.0, 100.0), (1.0, 0, 0), rule)[1].tolist() == [0, 6]


def plain_best_fit(lengths, capacity, weights, rule):
    """The stated rule over lists of open sequences, nothing closed early."""
    rooms, bins = [], []
    for size in lengths:
        demand = [size / capacity[0], 1 / capacity[1], size * size / capacity[2]]
        best, at = None, None
        for b, room in enumerate(rooms):
            left = [r - d for r, d in zip(room, demand)]
            if min(left) < -1e-9:
                continue
            score = (-sum(w * d * r for w, d, r in zip(weights, demand, room)) if rule == "dot"
                     else sum(w * x * x for w, x in zip(weights, left)))
            if best is None or score < best - 1e-12:
                best, at = score, b
        if at is None:
            rooms.append([1.0, 1.0, 1.0])
            at = len(rooms) - 1
        rooms[at] = [r - d for r, d in zip(rooms[at], demand)]
        bins.append((at, best))
    return bins, len(rooms)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity,weights", [((100.0, 4.0, 6000.0), (1.0, 0.3, 0.5)), ((100.0, 100.0, 10000.0), (1.0, 0.2, 0.2)),
                                              ((100.0, 2.0, 1e9), (0.0, 1.0, 0.0))])
def test_best_fit_chooses_as_the_plain_rule(rule, capacity, weights):
    rng = np.random.default_rng(8)
    lengths = np.sort(rng.integers(1, 70, 300))[::-1]
    bins, _ = packing.best_fit(lengths, capacity, weights, rule)
    want, count = plain_best_fit(lengths.tolist(), capacity, weights, rule)
    assert abs(len(set(bins.tolist())) - count) <= 1  # ties may open one more or one less
    # every choice is a best one: replay the choices against all open sequences
    rooms = {}
    for b, size in zip(bins.tolist(), lengths.tolist()):
        demand = np.array([size / capacity[0], 1 / capacity[1], size * size / capacity[2]])
        scores = {}
        for k, room in rooms.items():
            left = room - demand
            if left.min() >= -1e-9:
                scores[k] = -float((np.array(weights) * demand * room).sum()) if rule == "dot" else float((left * left) @ np.array(weights))
        if b in rooms:
            assert scores[b] <= min(scores.values()) + 1e-9
        else:
            assert not scores
        rooms[b] = rooms.get(b, np.ones(3)) - demand


def test_weights_of_documents_and_cost_take_part_and_keep_the_count():
    rng = np.random.default_rng(2)
    lengths = np.sort(np.concatenate([rng.integers(1, 600, 3000), rng.integers(600, 4097, 300)]))[::-1]
    capacity = (4096.0, 4096.0, 4096.0 ** 2)
    scalar = packing.best_fit(lengths, capacity, (1.0, 0.0, 0.0), "norm")[0]
    vector = packing.best_fit(lengths, capacity, (1.0, 0.2, 0.2), "norm")[0]
    assert (scalar != vector).any()
    assert len(set(vector.tolist())) <= len(set(scalar.tolist())) + 1
    assert len(set(vector.tolist())) <= 1.01 * lengths.sum() / 4096 + 1


def test_license_scan_counts_base_phrases_and_adds_labels(spark):
    texts = ODD + ["MIT License. the mit-license, Apache  License", "Licensed under CC BY-NC 4.0.", "mit", "licenseé mit license",
                   "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
                   "the general public license; GENERAL PUBLIC LICENSE", "of the and to the of the license and the"]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, texts)).collect()}
    phrases = {k: v.split() for k, v in {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}.items()}
    for d, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        places = sorted((i, k) for k, seq in phrases.items() for i in range(len(words)) if words[i:i + len(seq)] == seq)
        r = got[d]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({k for _, k in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[len(ODD) + 1].labels == "cc-by-nc" and got[len(ODD) + 4].labels == "mit"
    assert got[len(ODD) + 6].labels == "" and 0 <= got[len(ODD) + 6].score < 0.6
    assert license_scan.scan(frame(spark, texts).limit(0)).count() == 0


def test_license_scan_chains_over_foreign_words(spark):
    notice = "permission is hereby granted free of charge to any person {} obtaining a copy of this software and associated documentation files"
    texts = [notice.format("natural or legal"), notice.format("zwei drei vier fuenf"), notice.format("eins zwei drei vier fuenf"),
             "you may not use this file except in compliance with Acme license you may obtain a copy of the license at"]
    rows = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[d].labels for d in range(4)] == ["mit", "mit", "", "apache"]
    assert [rows[d].score for d in range(4)] == [1.0, 1.0, 0.5, 20 / 21]
    assert [(x.first_word, x.last_word, x.covered, x.length) for x in rows[0].spans] == [(0, 22, 20, 20)]


def test_suffix_automaton_gives_matching_statistics():
    rng = random.Random(2)
    sequences = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    automaton = license_scan.SuffixAutomaton(sequences)
    stream = [rng.randrange(4) for _ in range(200)]
    subs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for i, (state, n) in enumerate(automaton.statistics(stream)):
        longest = max((k for k in range(1, i + 2) if tuple(stream[i + 1 - k:i + 1]) in subs), default=0)
        assert n == longest
        if n:
            ends = {(k, e) for k, s in enumerate(sequences) for e in range(n - 1, len(s)) if s[e - n + 1:e + 1] == stream[i + 1 - n:i + 1]}
            assert automaton.ends[state] == ends


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automaton_finds_words_within_the_errors():
    terms = [toxicity.Term("abcab", False, 1), toxicity.Term("bac", False, 0), toxicity.Term("cabcabcab", False, 2),
             toxicity.Term("aab", True, 0)]
    words = toxicity.read_words([" ".join(noise(3000, "abcx", 11, seed=4)), None, "", "Abcab"])
    hits, kinds = toxicity.Automaton(terms).match(words)
    found = dict(zip(hits.tolist(), kinds.tolist()))
    for i, (a, b) in enumerate(zip(words.starts, words.ends)):
        word = "".join(map(chr, words.chars[a:b]))
        options = [edit_distance(word, t.text) for t in terms[:3] if edit_distance(word, t.text) <= t.errors]
        options += [0] if word.startswith("aab") else []
        assert (i in found) == bool(options), word
        if options:
            assert found[i] % 3 == min(options)


def test_toxicity_learns_scores_and_spares_quotations(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("aeioust") for _ in range(5)) for _ in range(40)]
    def text(extra):
        words = [rng.choice(plain) for _ in range(30)]
        for w in extra:
            words.insert(rng.randrange(len(words)), w)
        return " ".join(words)
    rows = [(i, text(["grumblewort"] if i % 8 == 0 else []), int(i % 8 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert any(t.text.startswith("grumble") for t in model.terms)
    probe = spark.createDataFrame([(1, text(["grumblewort"])), (2, text([])), (3, text(["grumblwort"])), (4, None), (5, ""),
                                   (6, 'she said "grumblewort" once'), (6, 'she said "grumblewort" once')],
                                  "doc_id long, text string")
    got = {r.doc_id: r.score for r in model.score(probe).collect()}
    assert got[1] >= 0.7 and got[3] >= 0.7
    assert max(got[2], got[4], got[5], got[6]) < 0.7
    assert sorted(r.doc_id for r in model.reject(probe, 0.7).collect()) == [2, 4, 5, 6, 6]
    assert model.score(probe.limit(0)).count() == 0
    seeds_only = toxicity.fit(docs, labels.limit(0))
    assert {t.text for t in seeds_only.terms} == set(toxicity.SEEDS)


def test_toxicity_keeps_every_term_of_a_wide_lexicon(spark):
    rng = random.Random(8)
    bad = sorted({"".join(rng.choice("bdfgklmnprz") for _ in range(8)) for _ in range(300)})
    plain = ["".join(rng.choice("aeioust") for _ in range(5)) for _ in range(40)]
    texts = [(bad * 10)[8 * i:8 * i + 8] + rng.sample(plain, 20) for i in range(len(bad) * 10 // 8)]
    texts = [" ".join(rng.sample(words, len(words))) for words in texts]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    rows += [(len(rows) + i, " ".join(rng.choice(plain) for _ in range(28)), 0) for i in range(10 * len(rows))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    probe = spark.createDataFrame([(i, f"aeiou {w} tosie") for i, w in enumerate(bad)], "doc_id long, text string")
    assert [r.doc_id for r in model.score(probe).collect() if r.score < 0.7] == []
    assert len(toxicity.Automata(model.terms).parts) > 1


def test_united_automata_hit_like_one(monkeypatch):
    rng = random.Random(9)
    terms = [toxicity.Term(t, i % 3 == 0, 2 if len(t) > 6 else 1 if len(t) > 4 else 0) for i, t in enumerate(dict.fromkeys(
        t for t in noise(40, "abc", 8, seed=6) if len(t) > 2))]
    rng.shuffle(terms)
    words = toxicity.read_words([" ".join(noise(2000, "abcx", 10, seed=7)), None, ""])
    hits, kinds = toxicity.Automaton(terms).match(words)
    monkeypatch.setattr(toxicity, "PART_TERMS", 5)
    got = toxicity.Automata(terms).match(words)
    assert len(hits) and got[0].tolist() == hits.tolist() and got[1].tolist() == kinds.tolist()


def test_language_model_base_is_exact_and_the_model_better(spark):
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    rng = random.Random(7)
    left, right = [f"l{i}" for i in range(30)], [f"R{i}é" for i in range(30)]
    def text():
        return " ".join(rng.choice(left if k % 2 else right) for k in range(rng.randint(20, 60)))
    texts = [text() for _ in range(300)] + ODD
    got = maxent_lm.score(frame(spark, texts), F.col("doc_id") % 5 == 0, batch_bytes=4000).collect()
    train = [blank_words(t) + ["\n"] for d, t in enumerate(texts) if d % 5] + [blank_words("null id") + ["\n"]]
    c = Counter(w for one in train for w in one)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts) + 2
    for r in got:
        words = blank_words("null id" if r.doc_id is None else texts[r.doc_id]) + ["\n"]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(c[w] > 0 for w in words), n)
        assert r.held_out == (r.doc_id is not None and r.doc_id % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)
    assert maxent_lm.score(frame(spark, texts).limit(0), F.lit(False)).count() == 0


def test_class_factors_sum_to_one():
    top = [(11, 50), (12, 40)]
    groups = [(0, 0, 30, 30), (1, 1, 20, 9), (3, 0, 64, 8)]
    k = maxent_lm.Classes(top, groups)
    words = np.array([11, 12, *range(100, 147)])
    counts = np.array([50, 40, *[1] * 30, *([2] * 7 + [3] * 2), *[8] * 8])
    shapes = np.array([0, 0, *[0] * 30, *[1] * 9, *[0] * 8])
    classes = k.of(words, counts, shapes)
    share = 10 ** k.log10_word(classes, counts)
    for c in set(classes.tolist()):
        total = share[classes == c].sum()
        unseen = 0.1 / (k.tokens[c] + 0.1 * (k.types[c] + 1))
        assert total + unseen == pytest.approx(1.0)
    table = np.random.default_rng(0).normal(size=(20, 4)).astype(np.float32)
    softmax = maxent_lm.Softmax(table, np.zeros(4, np.float32), block=3)
    rows = np.array([[1, 2, 3, 4], [0, 0, 5, 19], [7, 7, 7, 7], [9, 8, 7, 6]])
    logs = np.stack([softmax.log_share(rows, np.full(4, c)) for c in range(4)])
    assert np.exp(logs).sum(axis=0) == pytest.approx(1.0)
    exact = table[rows].sum(axis=1)
    assert logs.T == pytest.approx(exact - np.log(np.exp(exact).sum(axis=1, keepdims=True)), abs=1e-4)
