"""Language identification by cross-parsing entropy.

Each language is a suffix automaton of a sample of its labelled texts.  A text
is parsed against every automaton: the longest prefix of what is left of it
that occurs in the sample is a phrase, then the next one begins; a byte that
the sample does not hold is a phrase of its own.  The number of phrases times
log2 of the sample's length is the cross entropy of the text in bits
(Ziv and Merhav's estimate); the language that needs fewest wins.

Texts are parsed as UTF-8 bytes of their lower-cased letters, all else being
one blank.  Many blocks of text are parsed side by side, one byte of every
block and language per step, in one table that holds the next state and the
phrases that end there; blocks are ``block`` bytes of a text, and a phrase ends
with its block.  Texts of every length are read to the end.

The fit sample is bounded by two documented parameters: at most ``max_texts``
different texts per language, those of the least hash, and at most ``max_bytes``
of letters over all languages, shared equally.  It is found by the hashes of
all labelled texts, copies counted once, and is all that the driver sees.

Scores are ``1 - best / second`` of the entropies, 1 with a single language.
Ties go to the language with more different labelled texts, then to the lesser
name.

Edge cases: a null text or one without a letter is ``und`` with score 0; rows
with a null id and repeated rows get a result each; without any labelled text
with a letter every text is ``und``; an empty table gives an empty result;
other columns are ignored, whatever their names; rows without label or with a
null text teach nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays as A

UNKNOWN = "und"
SLICE = 1 << 19
SEPARATORS = A.byte_mask(bytes([*range(0x00, 0x61), *range(0x7B, 0x80)]))


def squeezed(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with every run of separators as one blank, and the new offsets.

    Bytes from 0x80 on belong to letters; the other signs among them are as
    foreign to every sample.
    """
    blank = SEPARATORS[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[off[:-1]] = True  # a text's first byte follows the line feed of the one before
    before = np.concatenate([[0], np.cumsum(keep)])
    return np.where(blank, 32, buf)[keep].astype(np.uint8), before[off]


class SuffixAutomaton:
    """States of all substrings of one byte string; ``next`` is one dict per state."""

    def __init__(self, text: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new, p = len(link), last
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            last = new
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p < 0:
                continue
            q = self.next[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
                continue
            twin = len(link)
            self.next.append(dict(self.next[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = twin
                p = link[p]
            link[q] = link[new] = twin


@dataclass
class Parser:
    """All languages' automata in one table.

    An entry is ``place of the next state's row << 2 | phrases that end``; rows
    have one entry per class of bytes, the last class for bytes of no sample.
    """
    table: np.ndarray
    classes: np.ndarray     # class of every byte
    roots: np.ndarray       # place of every language's first row
    bits: np.ndarray        # log2 of every sample's length

    @classmethod
    def of(cls, samples: list[bytes]) -> Parser:
        used = np.unique(np.frombuffer(b"".join(samples), np.uint8))
        classes = np.full(256, len(used), np.int64)
        classes[used] = np.arange(len(used))
        width, rows, roots = len(used) + 1, [], []
        at = 0
        for text in samples:
            states = SuffixAutomaton(text).next
            root = at * width
            first = np.full(width, root << 2 | 1, np.int64)
            for c, t in states[0].items():
                first[classes[c]] = (at + t) * width << 2
            # a state without the byte ends its phrase and starts over
            restart = first + 1
            block = np.tile(restart, (len(states), 1))
            block[0] = first
            for s, following in enumerate(states[1:], 1):
                if following:
                    block[s, classes[list(following)]] = (np.fromiter(following.values(), np.int64) + at) * width << 2
            rows.append(block)
            roots.append(root)
            at += len(states)
        return cls(np.concatenate(rows).ravel().astype(np.int32 if at * width < 1 << 29 else np.int64), classes,
                   np.array(roots), np.array([math.log2(max(2, len(t))) for t in samples]))

    def phrases(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(blocks x languages): phrases of every block of bytes."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        codes = self.classes[data].astype(self.table.dtype)
        place = np.repeat(self.roots[None, :], len(starts), axis=0).astype(self.table.dtype)
        count = np.zeros(place.shape, np.int32)
        # blocks that are longer than a step number come first
        active = np.searchsorted(-lengths, -np.arange(1, int(lengths.max(initial=0)) + 1), "right")
        for step, m in enumerate(active.tolist()):
            entry = self.table[place[:m] + codes[starts[:m] + step][:, None]]
            count[:m] += entry & 3
            place[:m] = entry >> 2
        count += place != self.roots
        out = np.empty_like(count)
        out[order] = count
        return out


def samples(labelled: DataFrame, text_col: str, label_col: str, max_texts: int,
            max_bytes: int) -> list[tuple[str, bytes]]:
    """(language, sample) in order of falling numbers of different texts."""
    rows = labelled.select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    texts = rows.select("lang", "h").distinct()
    least = Window.partitionBy("lang").orderBy("h")
    chosen = texts.withColumn("at", F.row_number().over(least)).where(F.col("at") <= max_texts).drop("at")
    sizes = {r.lang: r["count"] for r in texts.groupBy("lang").count().collect()}
    budget = max(1, max_bytes // max(1, len(sizes)))
    picked = (rows.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
              # more than the budget's bytes of one text are not needed
              .select("lang", "h", F.substring(F.lower("text"), 1, 2 * budget).alias("text")))
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for r in picked.collect():
        by_lang.setdefault(r.lang, []).append((r.h, r.text))
    out = []
    for lang in sorted(by_lang, key=lambda x: (-sizes[x], x)):
        found = [text for _, text in sorted(by_lang[lang])]
        # every text gives an equal share, what short ones leave goes to the next
        taken, left = [], budget
        for i, text in sorted(enumerate(found), key=lambda p: (len(p[1]), p[0])):
            buf = np.frombuffer(text.encode() + b"\n", np.uint8)
            data, _ = squeezed(buf, np.array([0, len(buf)]))
            part = data.tobytes()[:left // (len(found) - len(taken))]
            taken.append(part)
            left -= len(part)
        sample = b"".join(taken)
        if sample.strip(b" "):
            out.append((lang, sample))
    return out


def identify(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "lang", max_texts: int = 256, max_bytes: int = 1 << 17,
             block: int = 2048) -> DataFrame:
    """(doc_id, lang_pred, score, bits): one row per input row.

    ``bits``: the entropy of the text in the predicted language.
    """
    learned = samples(labelled, text_col, label_col, max_texts, max_bytes)
    languages = pa.array([lang for lang, _ in learned], pa.string())
    texts = [sample for _, sample in learned]
    key = hash((tuple(texts),))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = A.per_worker(("cross_parsing", key), lambda: Parser.of(texts)) if texts else None
        for rows, buf, off in A.slices(batches, "text", SLICE):
            has_letter = rows.column(2).to_numpy(zero_copy_only=False)
            n = len(rows)
            best, score, bits = np.full(n, -1), np.zeros(n), np.zeros(n)
            if parser is not None:
                data, off = squeezed(buf, off)
                length = np.diff(off)
                blocks = -(-length // block)
                text = np.repeat(np.arange(n), blocks)
                start = A.ragged(np.zeros(n, np.int64), blocks) * block
                phrases = parser.phrases(data, off[text] + start, np.minimum(block, length[text] - start))
                first = np.cumsum(blocks) - blocks  # every text has a block, its line feed at least
                cost = np.add.reduceat(phrases, first, axis=0) * parser.bits
                best = np.where(has_letter, cost.argmin(axis=1), -1)
                bits = np.where(has_letter, cost.min(axis=1), 0.0)
                if cost.shape[1] > 1:
                    score = np.where(has_letter, 1 - bits / np.maximum(np.partition(cost, 1, axis=1)[:, 1], 1e-9), 0.0)
                else:
                    score = has_letter.astype(float)
            names = languages.take(pa.array(best, mask=best < 0)).fill_null(UNKNOWN)
            yield pa.RecordBatch.from_arrays([rows.column(0), names, pa.array(score), pa.array(bits)],
                                             names=["doc_id", "lang_pred", "score", "bits"])

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text).alias("text"),
                     F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")
