"""Collocation mining against a plain statement of its rules."""
import random
import re
from collections import Counter

import duckdb
import numpy as np

from conftest import SF_SMALL
from ledgerline.llm import collocations, queries
from ledgerline.llm import quotient_filter as Q


def plain(rows, min_count=30, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    kept = {}
    for (lang, w), a in cand.items():
        inside = [b for (x, v), b in cand.items() if x == lang and len(v) > len(w)
                  and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= 80 * a for b in inside):
            continue
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        kept.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, r, p.decode(), -a, l, rr, total[lang], -s) for lang, found in kept.items()
            for r, (s, a, p, l, rr) in enumerate(sorted(found)[:top], 1)}


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = ["Aa", "b", "ccc", "é", "日本", "x'y", "zz", "q"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"])
                       for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["de", "en", None, "und"]), text))
    # a phrase inside a longer one, repeated rows, a long text, empty ones
    rows += [("en", "one two three four. one two")] * 40 + [("en", None), ("en", ""), ("fr", " .,; ")]
    rows.append(("de", "lang lang lang " * 30_000))
    return rows


def test_matches_plain_counting(spark, monkeypatch):
    rows = corpus(900)
    df = spark.createDataFrame([(a, t, "x", i, 1) for i, (a, t) in enumerate(rows)],
                               "lang string, text string, phrase string, n long, slice int").repartition(5)
    want = plain(rows)
    assert len(want) > 100
    assert {tuple(r) for r in collocations.mine(df).collect()} == want
    # small slices and buffers: many filters of every part, the same result
    monkeypatch.setattr(collocations, "SLICE", 1 << 9)
    monkeypatch.setattr(collocations, "BUFFER", 40)
    monkeypatch.setattr(collocations, "PART_WORDS", 1 << 6)
    assert {tuple(r) for r in collocations.mine(df, top=7).collect()} == plain(rows, top=7)


def test_empty_table_and_texts(spark):
    df = spark.createDataFrame([("en", "a b"), ("en", None), (None, "")], "lang string, text string")
    assert collocations.mine(df).count() == 0
    assert collocations.mine(df.limit(0)).count() == 0


def test_filters_keep_every_key_and_counter():
    rng = np.random.default_rng(1)
    for n, bits, part_bits in [(2, 3, 2), (2, 20, 6), (3, 17, 6), (4, 16, 6), (4, 32, 9), (3, 30, 5), (2, 1, 1)]:
        shape = Q.Shape(n, bits, part_bits)
        words = [rng.integers(1, 1 << bits, 3000).astype(np.uint64) for _ in range(n)]
        counts = rng.choice([1, 2, 254, 255, 256, 10 ** 12], 3000)
        want = Counter()
        for key, c in zip(zip(*(w.tolist() for w in words)), counts.tolist()):
            want[key] += c
        left, right = shape.permute(words)
        assert all((a == b).all() for a, b in zip(shape.invert(left, right), words))
        # three shards, merged part by part
        by_part = {}
        for k in range(3):
            for part, raw in Q.shards(shape, *shape.sorted(left[k::3], right[k::3], counts[k::3])):
                by_part.setdefault(part, []).append(raw)
        got = Counter()
        for part, filters in by_part.items():
            le, ri, c = Q.merged(shape, part, filters)
            assert (shape.part(le) == part).all()
            got.update(dict(zip(zip(*(w.tolist() for w in shape.invert(le, ri))), c.tolist())))
        assert got == want


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    df = queries.QUERIES["op13_phrase_collocations"](spark, SF_SMALL)
    cols = ", ".join(df.columns)
    want = con.execute(f"SELECT {cols} FROM ({queries.ORACLES['op13_phrase_collocations']})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
