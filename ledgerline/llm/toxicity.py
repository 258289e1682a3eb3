"""Toxicity: Levenshtein automata over a learned lexicon, weighed by context.

``fit`` learns a lexicon from labelled texts: words and word beginnings whose
occurrences stand almost only in toxic texts.  Occurrences are counted by
their distinct neighbours, so copies of one text count once.  The lexicon is a
trie; the positions (trie node, errors so far) of a Levenshtein automaton are
intersected with it and made deterministic, so that one table look-up per
character finds every listed term and its misspellings (one error from
``one_error_from`` letters, two from ``two_errors_from``).  Every term that
passes the evidence tests is listed; a long lexicon is dealt over several such
tables, whose hits are united.  A hit is taken as
quoted where quotation marks or words of reporting stand around it inside a
window of words.  Every (term, errors, quoted) gets the smoothed share of
toxic texts among the labelled texts that hold it, and a text's score is the
noisy-or of these.

The classifier is fitted on a bounded sample: at most ``max_fit_rows``
labelled rows, chosen by a hash of their id; the candidate terms of its
toxic part are found in one task of that bound.  Scoring covers every row.

Edge cases: a null or empty text gets the base score; repeated rows get equal
scores; without any labels only the seed terms count; other columns are
ignored; an empty table gives an empty result; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import arrays as A

# Seed terms known without labels; marks and words that report
# someone else's speech (English, German, French, Spanish).
SEEDS = ["idiot", "moron", "stupid", "loser", "scum"]
QUOTES = "\"“”„«»‹›"
REPORTING = {"said", "says", "called", "quote", "quoted", "wrote", "word", "term", "sagte", "schrieb",
             "wort", "dit", "écrit", "mot", "dijo", "escribió", "palabra"}
# characters that end a word: ASCII other than letters and digits, no-break
# space to divide sign where not a letter, general punctuation
_BREAKS = [*(c for c in range(128) if not chr(c).isalnum()), 0x85, 0xA0, 0xA1, 0xA7, 0xAB, 0xB7, 0xBB, 0xBF,
           0xD7, 0xF7, *range(0x2000, 0x2070), *range(0x3000, 0x3020)]
PART_TERMS = 128
SLICE = 1 << 18  # bytes of text that are scored at once


@dataclass
class Term:
    text: str
    stem: bool = False  # a word may go on after it
    errors: int = 0


@dataclass
class Words:
    """Lower-cased words of a slice as spans of code points."""

    chars: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first word of every text, then the total
    edges: np.ndarray  # first character of every text, then the total


def read_words(texts: list[str | None]) -> Words:
    low = [(t or "").lower() + "\n" for t in texts]
    chars = np.frombuffer("".join(low).encode("utf-32-le"), "<u4")
    breaks = np.zeros(0x3020, bool)
    breaks[_BREAKS] = True
    inside = np.zeros(len(chars) + 2, np.int8)
    inside[1:-1] = ~breaks[np.minimum(chars, 0x301F)] | (chars > 0x301F)
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))])
    return Words(chars, starts, ends, np.searchsorted(starts, edges), edges)


class Automaton:
    """Trie of terms intersected with their Levenshtein automata, as a table.

    ``table[state, class]`` is the next state, 0 the dead one, 1 the start;
    ``accept[state]`` is 3 * term + errors for the hit with fewest errors, or
    -1.  Classes: 0 for characters outside the lexicon.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.alphabet = sorted({c for t in terms for c in t.text})
        klass = {c: i for i, c in enumerate(self.alphabet, 1)}
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        reach = [0]  # most errors that a term below the node allows
        for k, t in enumerate(terms):
            node = 0
            reach[0] = max(reach[0], t.errors)
            for c in t.text:
                if klass[c] not in children[node]:
                    children[node][klass[c]] = len(children)
                    children.append({})
                    ends.append([])
                    reach.append(0)
                node = children[node][klass[c]]
                reach[node] = max(reach[node], t.errors)
            ends[node].append(k)

        def closed(positions) -> frozenset:
            """Add skipped letters and finished stems, keep the fewest errors."""
            best: dict = {}
            todo = list(positions)
            while todo:
                where, errors = todo.pop()
                if best.get(where, 9) <= errors:
                    continue
                if isinstance(where, int):
                    if errors > reach[where]:
                        continue
                    todo += [(child, errors + 1) for child in children[where].values()]
                    todo += [(("done", k), errors) for k in ends[where] if terms[k].stem and errors <= terms[k].errors]
                best[where] = errors
            return frozenset(best.items())

        def step(state: frozenset, c: int) -> frozenset:
            out = []
            for where, errors in state:
                if not isinstance(where, int):
                    out.append((where, errors))
                    continue
                if c in children[where]:
                    out.append((children[where][c], errors))
                if errors < reach[where]:
                    out.append((where, errors + 1))
                    out += [(child, errors + 1) for child in children[where].values()]
            return closed(out)

        def hit(state: frozenset) -> int:
            found = [(e, k) for w, e in state
                     for k in ([w[1]] if not isinstance(w, int) else
                               [k for k in ends[w] if e <= terms[k].errors])]
            return 3 * min(found)[1] + min(found)[0] if found else -1

        states = {frozenset(): 0, closed([(0, 0)]): 1}
        rows, accept, todo = {0: [0] * (len(klass) + 1)}, {0: -1}, [closed([(0, 0)])]
        while todo:
            state = todo.pop()
            row = []
            for c in range(len(klass) + 1):
                nxt = step(state, c)
                if nxt not in states:
                    states[nxt] = len(states)
                    todo.append(nxt)
                row.append(states[nxt])
            rows[states[state]], accept[states[state]] = row, hit(state)
        self.table = np.array([rows[i] for i in range(len(states))], np.int32)
        self.accept = np.array([accept[i] for i in range(len(states))], np.int32)

    def classes(self, chars: np.ndarray) -> np.ndarray:
        """The class of every character: a table for the scripts below U+3020,
        a search in the sorted alphabet for the others."""
        letters = np.array([ord(c) for c in self.alphabet], np.uint32)
        table = np.zeros(0x3020, np.int32)
        low = letters < len(table)
        table[letters[low]] = np.flatnonzero(low) + 1
        code = table[np.minimum(chars, len(table) - 1)]
        far = np.flatnonzero(chars >= len(table))
        code[far] = 0
        if len(far) and not low.all():
            at = np.minimum(np.searchsorted(letters, chars[far]), len(letters) - 1)
            code[far] = np.where(letters[at] == chars[far], at + 1, 0)
        return code

    def match(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers that hit, and 3 * term + errors of each."""
        code = self.classes(words.chars)
        live = np.arange(len(words.starts))
        state = np.ones(len(live), np.int32)
        place = words.starts.copy()
        hits, kinds = [], []
        while len(live):
            state = self.table[state, code[place]]
            place += 1
            over = place == words.ends[live]
            kind = np.where(over, self.accept[state], -1)
            hits.append(live[kind >= 0])
            kinds.append(kind[kind >= 0])
            on = ~over & (state > 0)
            live, state, place = live[on], state[on], place[on]
        hit, kind = np.concatenate(hits or [live]), np.concatenate(kinds or [live])
        order = np.argsort(hit)
        return hit[order], kind[order]


class Automata:
    """Terms dealt over automata of at most ``PART_TERMS`` terms, hits united.

    Neighbours in the alphabet share an automaton, so that a trie stays narrow.
    A word's hit is the one with fewest errors, as if one table held all terms.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        order = sorted(range(len(terms)), key=lambda k: terms[k].text)
        self.parts = []
        for a in range(0, len(terms), PART_TERMS):
            own = sorted(order[a:a + PART_TERMS])
            self.parts.append((Automaton([terms[k] for k in own]), np.array(own, np.int64)))

    def match(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers that hit, and 3 * term + errors of each."""
        if len(self.parts) == 1:
            return self.parts[0][0].match(words)
        # every distinct word is read once by each automaton
        _, at, back = np.unique(_hash(words.chars, words.starts, words.ends), return_index=True, return_inverse=True)
        distinct = Words(words.chars, words.starts[at], words.ends[at], words.first, words.edges)
        best = np.full(len(at), 3 * len(self.terms), np.int64)  # errors first, then term
        for automaton, own in self.parts:
            hit, kind = automaton.match(distinct)
            best[hit] = np.minimum(best[hit], kind % 3 * len(self.terms) + own[kind // 3])
        best = best[back]
        hits = np.flatnonzero(best < 3 * len(self.terms))
        return hits, 3 * (best[hits] % max(1, len(self.terms))) + best[hits] // max(1, len(self.terms))


def _hash(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return A.span_hashes(chars, starts, ends, seed=3)


def quoted(words: Words, hits: np.ndarray, window: int) -> np.ndarray:
    """Whether quotation marks enclose a hit, or reporting words precede it,
    within ``window`` words of its own text."""
    marks = np.concatenate([[0], np.cumsum(np.isin(words.chars, [ord(c) for c in QUOTES]))])
    text = np.searchsorted(words.first, hits, "right") - 1
    lo = np.maximum(hits - window, words.first[text])
    hi = np.minimum(hits + window, words.first[text + 1] - 1)
    left = np.where(lo == words.first[text], words.edges[text], words.starts[lo])
    right = np.where(hi == words.first[text + 1] - 1, words.edges[text + 1], words.ends[hi])
    before = marks[words.starts[hits]] - marks[left]
    after = marks[right] - marks[words.ends[hits]]
    out = (before > 0) & (after > 0)
    for i in np.flatnonzero(~out):
        near = range(lo[i], hits[i])
        out[i] = any("".join(map(chr, words.chars[words.starts[j]:words.ends[j]])) in REPORTING for j in near)
    return out


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    weights: dict[int, float] = field(default_factory=dict)  # 2 * (3 * term + errors) + quoted
    base: float = 0.05
    window: int = 6

    def strength(self, key: int) -> float:
        # unseen kinds: their prior share
        return self.weights.get(key, prior_share(key))

    def score(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score) of every row."""
        automaton, base = Automata(self.terms), self.base
        window, strength = self.window, self.strength

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, words, hits, keys in find(batches, automaton, window):
                scores = np.full(len(rows), 1.0 - base)
                text = np.searchsorted(words.first, hits, "right") - 1
                for d, key in set(zip(text.tolist(), keys.tolist())):
                    scores[d] *= 1.0 - strength(key)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(1.0 - scores)], names=["doc_id", "score"])

        rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        return rows.mapInArrow(run, "doc_id long, score double")


    def reject(self, df: DataFrame, threshold: float, text_col: str = "text") -> DataFrame:
        """The rows, whole, whose score is below the threshold."""
        automaton, base, window, strength = Automata(self.terms), self.base, self.window, self.strength

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, words, hits, keys in find(batches, automaton, window, text_col):
                clean = np.full(len(rows), 1.0 - base)
                text = np.searchsorted(words.first, hits, "right") - 1
                for d, key in set(zip(text.tolist(), keys.tolist())):
                    clean[d] *= 1.0 - strength(key)
                yield rows.filter(pa.array(1.0 - clean < threshold))

        return df.mapInArrow(run, df.schema)


def prior(key: int) -> tuple[float, float]:
    """Pseudo-counts (toxic, clean) of a kind of hit."""
    errors, in_quotes = key // 2 % 3, key % 2
    if in_quotes:
        return 1.0, 3.0
    return (8.0, 1.0) if errors == 0 else (4.0, 1.0) if errors == 1 else (2.0, 1.0)


def prior_share(key: int) -> float:
    a, b = prior(key)
    return a / (a + b)


def find(batches, automaton: Automata, window: int, text_col: str = "text"):
    """(rows, words, hits, keys) per slice; key = 2 * (3 * term + errors) + quoted."""
    A.claimed("toxicity")
    for rows, _, _ in A.slices(batches, text_col, SLICE):
        words = read_words(rows.column(rows.schema.get_field_index(text_col)).to_pylist())
        hits, kinds = automaton.match(words)
        yield rows, words, hits, 2 * kinds.astype(np.int64) + quoted(words, hits, window)


STEMS = (4, 5, 6, 7, 8)


def _kinds_of(words: Words):
    """(letters kept, word numbers, hashes); 0 letters stands for whole words."""
    for n in (0, *STEMS):
        which = np.flatnonzero(words.ends - words.starts >= max(n, 3)) if n else np.arange(len(words.starts))
        ends = words.ends[which] if not n else words.starts[which] + n
        yield n, which, _hash(words.chars, words.starts[which], ends)


def _candidates(texts: list[str], min_contexts: int) -> dict:
    """Terms of the toxic texts: (letters, hash) -> [term, contexts, word numbers]."""
    words = read_words(texts)
    own = _hash(words.chars, words.starts, words.ends)
    with np.errstate(over="ignore"):
        around = np.roll(own, 1) * np.uint64(0x9E3779B97F4A7C15) + np.roll(own, -1)
    out = {}
    for n, which, h in _kinds_of(words):
        order = np.argsort(h, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else np.empty(0, int)
        for a, b in zip(edges, [*edges[1:], len(order)]):
            if b - a < min_contexts:
                continue
            at = which[order[a:b]]
            contexts = len(np.unique(around[at]))
            w = at[0]
            if contexts >= min_contexts and words.ends[w] - words.starts[w] >= 3:
                end = words.starts[w] + n if n else words.ends[w]
                term = "".join(map(chr, words.chars[words.starts[w]:end]))
                out[n, int(h[order[a]])] = [term, contexts, at]
    return out


def _lexicon(batches, min_contexts: int, evidence: float):
    """Rows (term, stem) from rows ordered with the toxic ones first."""
    A.claimed("toxicity")
    toxic_texts: list[str] = []
    found: dict | None = None
    clean: dict = {}
    sizes = [0, 0]
    tables: dict = {}
    for rows, _, _ in A.slices(batches, "text"):
        flags = np.array(rows.column(rows.schema.get_field_index("toxic")).to_pylist(), bool)
        texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
        toxic_texts += [t or "" for t, x in zip(texts, flags) if x]
        rest = [t for t, x in zip(texts, flags) if not x]
        if not rest:
            continue
        if found is None:
            found = _candidates(toxic_texts, min_contexts)
            tables = {n: np.sort(np.array([h for k, h in found if k == n], np.uint64)) for n in (0, *STEMS)}
        words = read_words(rest)
        sizes[0] += len(words.starts)
        for n, which, h in _kinds_of(words):
            if len(tables[n]):
                at = np.minimum(np.searchsorted(tables[n], h), len(tables[n]) - 1)
                hit = tables[n][at] == h
                doc = np.searchsorted(words.first, which[hit], "right")
                for one, _ in set(zip(h[hit].tolist(), doc.tolist())):
                    clean[n, one] = clean.get((n, one), 0) + 1
    if found is None:
        found = _candidates(toxic_texts, min_contexts)
    sizes[1] = len(read_words(toxic_texts).starts)
    share = sizes[1] / max(1, sum(sizes))
    good = []
    for key, (term, contexts, at) in found.items():
        against = clean.get(key, 0)
        gain = contexts * np.log(contexts / ((contexts + against) * share)) if share < 1 else 0.0
        if contexts >= 30 * against and gain >= evidence:
            good.append((contexts, key[0], term, at))
    # most contexts first, whole words before beginnings, long ones before short
    good.sort(key=lambda x: (-x[0], x[1] > 0, -x[1], x[2]))
    covered: set[int] = set()
    kept = []
    for contexts, n, term, at in good:
        new = [w for w in at.tolist() if w not in covered]
        if len(new) >= min_contexts:
            covered.update(new)
            kept.append((term, n > 0))
    return kept


def allowed_errors(term: str, one_error_from: int, two_errors_from: int) -> int:
    return 2 if len(term) >= two_errors_from else 1 if len(term) >= one_error_from else 0


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", seeds: list[str] | None = None, max_fit_rows: int = 16_000,
        min_contexts: int = 5, evidence: float = 20.0,
        one_error_from: int = 5, two_errors_from: int = 9, window: int = 6) -> Model:
    """Learn from ``labels`` (already restricted to the rows to learn from)."""
    seeds = SEEDS if seeds is None else seeds
    chosen = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
              .where("doc_id is not null and toxic in (0, 1)")
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows))
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most max_fit_rows ids: a bounded broadcast
    sample = checkpointed(texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _lexicon(batches, min_contexts, evidence)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in terms], pa.string()),
                                          pa.array([s for _, s in terms], pa.bool_())], names=["term", "stem"])

    learned = sample.repartition(1).sortWithinPartitions(F.desc("toxic")).mapInArrow(learn, "term string, stem boolean")
    terms = [Term(r.term, r.stem, allowed_errors(r.term, one_error_from, two_errors_from)) for r in learned.collect()]
    have = {t.text for t in terms}
    terms += [Term(s, False, allowed_errors(s, one_error_from, two_errors_from)) for s in seeds
              if s not in have and not any(t.stem and s.startswith(t.text) for t in terms)]
    automaton = Automata(terms)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, found, keys in find(batches, automaton, window):
            toxic = rows.column(rows.schema.get_field_index("toxic")).to_pylist()
            text = np.searchsorted(words.first, found, "right") - 1
            pairs = sorted(set(zip(text.tolist(), keys.tolist())))
            none = sorted(set(range(len(rows))) - {d for d, _ in pairs})
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k in pairs] + [-1] * len(none), pa.int64()),
                                              pa.array([toxic[d] for d, _ in pairs] + [toxic[d] for d in none],
                                                       pa.int32())], names=["kind", "toxic"])

    counts = (sample.mapInArrow(hits, "kind long, toxic int").groupBy("kind")
              .agg(F.sum("toxic").alias("n1"), F.count("*").alias("n")).collect())
    model = Model(terms, {}, 0.05, window)
    for r in counts:
        if r.kind < 0:
            model.base = min(0.2, (r.n1 + 0.5) / (r.n + 10))
        else:
            a, b = prior(r.kind)
            share = (r.n1 + a) / (r.n + a + b)
            model.weights[r.kind] = share if share >= 0.5 or r.kind % 2 else 0.0
    return model
