"""License scans: matching statistics against a generalised suffix automaton.

The licence templates are token sequences.  One generalised suffix automaton
over all of them is built on the driver (a few hundred states, bounded by the
templates) and travels with the task.  Every text is streamed through it: the
state after each token gives the matching statistic, the length of the longest
suffix of the tokens read so far that occurs in some template, and where it
ends there.  Maximal matches of at least ``min_match`` tokens are chained per
template, in order on both sides with gaps of at most ``max_gap`` tokens; a
chain is a covered template span.  A template whose best chain covers at least
``min_cover`` of its tokens gives its label.

Tokens that no template holds reset the automaton, so only runs of template
tokens are streamed; they are found with one vectorised lookup.  The matches of
all runs of a text are chained together by their word positions in the text, so
foreign words inside a notice count as gap like any others.

Edge cases: a null or empty text has no words, no labels and score 0; repeated
rows give equal rows; other columns of the input are ignored, whatever their
names; an empty table gives an empty result; a text's length does not matter
(bounded slices, one text at least).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

# Phrases of the base scan and short notices of well-known
# licences (label, notice), as published by their stewards.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("apache", "licensed under the Apache License Version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a "
               "copy of the license at"),
    ("gpl", "this work is licensed under the GNU General Public License version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms "
            "of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "licensed under CC BY 4 0"),
    ("cc-by-sa", "licensed under CC BY SA 4 0"),
    ("cc-by-nc", "licensed under CC BY NC 4 0"),
    ("cc-by", "this work is licensed under a Creative Commons Attribution 4 0 International License"),
]

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans array<struct<label:string,template:int,"
          "first_word:long,last_word:long,covered:int,length:int>>")


def tokenise(text: str) -> list[bytes]:
    buf = A.LOWER_AZ[np.frombuffer(text.encode(), np.uint8)]
    s, e = A.word_spans(buf, A.byte_mask(A.NOT_ALNUM))
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(s, e)]


class SuffixAutomaton:
    """Generalised suffix automaton of token-id sequences.

    ``link``/``length`` per state, ``next`` as one dict per state and
    ``ends``: (template, end position) pairs of the state's occurrences.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._add(last, c)
                self.ends[last].add((k, i))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _add(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # the string is there already, from an earlier template
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(state, matched length) after each token."""
        out, s, n = [], 0, 0
        for c in tokens:
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            t = self.next[s].get(c)
            s, n = (t, n + 1) if t is not None else (0, 0)
            out.append((s, n))
        return out


def chain(matches: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int]]:
    """Chains (first word, last word, covered template tokens) of one template.

    ``matches``: (text start, template start, length) in text order.  A match
    joins the chain that covers most among those ending before it on both
    sides within ``max_gap`` tokens; overlaps count once.
    """
    chains: list[list[int]] = []  # text end, template end, covered, text start
    near: list[list[int]] = []  # those that a match can still join
    for at, place, n in matches:
        near = [ch for ch in near if at - ch[0] <= max_gap]
        best, gain = None, n
        for ch in near:
            skip = max(0, ch[0] - at, ch[1] - place)
            if skip < n and at + skip - ch[0] <= max_gap and place + skip - ch[1] <= max_gap \
                    and ch[2] + n - skip > gain:
                best, gain = ch, ch[2] + n - skip
        if best is None:
            chains.append([at + n, place + n, n, at])
            near.append(chains[-1])
        else:
            best[:3] = [at + n, place + n, gain]
    return [(ch[3], ch[0] - 1, ch[2]) for ch in chains]


def _matches(run: list[int], first: int, automaton: SuffixAutomaton, min_match: int,
             by_template: dict[int, list[tuple[int, int, int]]]) -> None:
    """Add the maximal matches of one run, which starts at word ``first`` of its text."""
    stats = automaton.statistics(run)
    for i, (state, n) in enumerate(stats):
        # a match is maximal where the next token does not lengthen it
        if n >= min_match and (i + 1 == len(stats) or stats[i + 1][1] != n + 1):
            for k, end in automaton.ends[state]:
                by_template.setdefault(k, []).append((first + i - n + 1, end - n + 1, n))


def _best_spans(by_template: dict[int, list[tuple[int, int, int]]], lengths: list[int],
                max_gap: int) -> list[tuple[int, int, int, int]]:
    """Covered spans (template, first word, last word, covered) of one text."""
    return [(k, a, b, min(covered, lengths[k])) for k, found in by_template.items()
            for a, b, covered in chain(sorted(found), max_gap)]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
         min_match: int = 3, max_gap: int = 4, min_cover: float = 0.6) -> DataFrame:
    """One row per input row: id, word count, base phrases, labels, spans."""
    templates = TEMPLATES if templates is None else templates
    phrases = BASE_PHRASES if phrases is None else phrases
    token_lists = [tokenise(t) for _, t in templates]
    vocabulary = sorted({w for seq in [*token_lists, *map(tokenise, phrases)] for w in seq})
    word_id = {w: i for i, w in enumerate(vocabulary)}
    sequences = [[word_id[w] for w in seq] for seq in token_lists]
    automaton = SuffixAutomaton(sequences)
    lengths, labels = [len(s) for s in sequences], [label for label, _ in templates]
    phrase_ids = [([word_id[w] for w in tokenise(p)], label) for p, label in phrases.items()]
    keys = np.array([A.hash_of(w) for w in vocabulary], np.uint64)
    order = np.argsort(keys)
    keys, ids = keys[order], order.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        separators = A.byte_mask(A.NOT_ALNUM)
        for rows, buf, off in A.slices(batches, "text"):
            buf = A.LOWER_AZ[buf]
            s, e = A.word_spans(buf, separators)
            hashes = A.span_hashes(buf, s, e)
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            known = keys[at] == hashes
            word = np.where(known, ids[at], -1)
            first = A.per_text(s, off)
            n = len(rows)
            base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            for seq, label in phrase_ids:
                hit = np.ones(max(0, len(word) - len(seq) + 1), bool)
                for k, w in enumerate(seq):
                    hit &= word[k:len(word) - len(seq) + 1 + k] == w
                where = np.flatnonzero(hit)
                doc = np.searchsorted(first, where, "right") - 1
                fits = where + len(seq) <= first[doc + 1] if len(where) else np.empty(0, bool)
                for d, p in zip(doc[fits], where[fits]):
                    base[d].append((int(p - first[d]), label))
            matches: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in range(n)]
            edge = np.diff(np.concatenate([[0], known.astype(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            keep = b - a >= min_match
            for p, q in zip(a[keep], b[keep]):
                d0, d1 = np.searchsorted(first, [p, q - 1], "right") - 1
                for d in range(d0, d1 + 1):  # a run may touch several texts
                    x, y = max(p, first[d]), min(q, first[d + 1])
                    if y - x >= min_match:
                        _matches(word[x:y].tolist(), int(x - first[d]), automaton, min_match, matches[d])
            spans = [_best_spans(m, lengths, max_gap) for m in matches]
            out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ", 7)}
            for d in range(n):
                places = sorted(p for p, _ in base[d])
                base_labels = sorted({x for _, x in base[d]})
                good = [(k, x, y, c) for k, x, y, c in spans[d] if c >= min_cover * lengths[k]]
                best = max([c / lengths[k] for k, _, _, c in spans[d]], default=0.0)
                out["n_words"].append(int(first[d + 1] - first[d]))
                out["n_base"].append(len(places))
                out["first_word"].append(places[0] if places else None)
                out["last_word"].append(places[-1] if places else None)
                out["base_labels"].append(",".join(base_labels))
                out["labels"].append(",".join(sorted({*base_labels, *(labels[g[0]] for g in good)})))
                out["score"].append(1.0 if places else min(1.0, best))
                out["spans"].append([{"label": labels[k], "template": k, "first_word": x, "last_word": y,
                                      "covered": c, "length": lengths[k]} for k, x, y, c in good])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(out[f.name], f.type) for f in fields)],
                names=[rows.schema.names[0], *(f.name for f in fields)])

    span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()),
                      ("last_word", pa.int64()), ("covered", pa.int32()), ("length", pa.int32())])
    fields = [pa.field(c, t) for c, t in [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))]]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + SCHEMA)
