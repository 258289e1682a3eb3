"""Toxicity lexicons in scripts with many letters."""
import random

from ledgerline.llm import toxicity


def test_lexicons_of_many_letters_match(spark):
    rng = random.Random(2)
    han = [chr(0x4E00 + i) for i in range(600)]
    texts = list(dict.fromkeys("".join(rng.sample(han, 4)) for _ in range(toxicity.PART_TERMS)))
    terms = [toxicity.Term(t, False, 1) for t in texts]
    terms += [toxicity.Term("дурак", True, 1), toxicity.Term("ばかやろう", False, 1), toxicity.Term("abcde", False, 1)]
    automaton = toxicity.Automata(terms)
    said = texts[:40] + ["дураки", "ばかやろ", "abxde", "无关紧要的", "xyz", "漢"]
    words = toxicity.read_words([" ".join(said)])
    hits, kinds = automaton.match(words)
    assert set(hits.tolist()) == set(range(43))
    assert [kinds[hits.tolist().index(i)] for i in range(40)] == [3 * i for i in range(40)]
    errors = {i: int(k) % 3 for i, k in zip(hits.tolist(), kinds.tolist())}
    assert (errors[40], errors[41], errors[42]) == (0, 1, 1)
