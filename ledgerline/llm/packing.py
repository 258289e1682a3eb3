"""Best-fit packing of tokenised documents under several capacities.

``tokenise`` cuts every document into pieces of at most ``max_tokens`` ids;
``pack`` places pieces into sequences.  A sequence has three capacities:
tokens, documents and attention cost (the sum of squared piece lengths).  A
piece goes to the open sequence that fits it under all of them and that wins
by the chosen rule: the largest weighted dot product of the piece's demand
and the residual capacities (``dot``), or the smallest weighted norm of what
the piece would leave (``norm``).  Pieces are taken by descending demand.

Pieces are dealt by a hash into groups of about ``group_pieces``, each packed
in one task; a group leaves at most one ill-filled sequence, so the number of
sequences stays within a few per mille of a global packing while no task
depends on the size of the input.

Edge cases: a null or empty text is a piece that holds the end id alone;
repeated rows (also of one id) are packed as pieces of their own; other
columns are ignored; an empty table gives an empty result; a long text gives
as many pieces as it needs.  A piece that breaks a capacity on its own gets a
sequence to itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

SLICE = 1 << 19  # bytes of text that a task looks at
WORDS = 1 << 12  # words that the library encodes at a time: it takes about a kilobyte for each


class WordTokenizer:
    """Ids of white-space separated words by a ``tokenizers`` file.

    The file's normaliser and pre-tokeniser never join text across ASCII
    white space, so every distinct word is encoded once.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are text

    def describe(self, spans: list[bytes]) -> list[A.Ragged]:
        flat, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for a in range(0, len(spans), WORDS):
            coded = self.tokenizer.encode_batch_fast([s.decode() for s in spans[a:a + WORDS]], add_special_tokens=False)
            ids = [c.ids for c in coded]
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths[-1].sum())))
        return [A.Ragged(np.concatenate(flat), np.concatenate(lengths))]


def tokenise(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
             max_tokens: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = A.per_worker(("words", vocabulary), lambda: WordTokenizer(vocabulary))
        table = A.per_worker(("words spans", vocabulary), lambda: A.SpanTable(words.describe, limit=1_000_000))
        blanks = A.byte_mask(A.BLANKS)
        for rows, buf, off in A.slices(batches, "text", SLICE):
            s, e = A.word_spans(buf, blanks)
            which, (ids,) = table.find(buf, s, e)
            taken = ids.take(which)
            edge = np.concatenate([[0], np.cumsum(taken.lengths)])[A.per_text(s, off)]
            row, piece, start, length, crc, lists = [], [], [], [], [], []
            for d, (a, b) in enumerate(zip(edge.tolist(), edge[1:].tolist())):
                one = np.append(taken.flat[a:b], end_id).astype("<u4")
                for k in range(0, len(one), max_tokens):
                    part = one[k:k + max_tokens]
                    row.append(d)
                    piece.append(k // max_tokens)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        lists.append(part)
            out = [rows.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"
                           + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float],
             rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece; ``lengths`` in descending order."""
    cap, w = np.array(capacity, float), np.array(weights, float)
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    room = np.empty((1024, 3))  # residual share of every capacity, by open sequence
    name = np.empty(1024, np.int64)
    used: list[int] = []
    is_open = 0
    slack = 1e-9
    least = lengths.min() / cap[0] if n else 0.0
    for i, size in enumerate(lengths.tolist()):
        demand = np.array([size, 1.0, float(size) * size]) / cap
        at = -1
        if is_open:
            rest = room[:is_open] - demand
            fits = (rest >= -slack).all(axis=1)
            if rule == "dot":
                score = np.where(fits, room[:is_open] @ (w * demand), -np.inf)
                at = int(score.argmax())
            else:
                score = np.where(fits, (rest * rest) @ w, np.inf)
                at = int(score.argmin())
            if not fits[at]:
                at = -1
        if at < 0:
            if is_open == len(room):
                room, name = np.concatenate([room, np.empty_like(room)]), np.concatenate([name, np.empty_like(name)])
            at = is_open
            room[at], name[at] = 1.0, len(used)
            used.append(0)
            is_open += 1
        b = int(name[at])
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        room[at] -= demand
        if room[at, 0] < least - slack or room[at].min() <= slack:  # no later piece can fit
            is_open -= 1
            room[at], name[at] = room[is_open], name[is_open]
    return bins, offsets


def pack(pieces: DataFrame, max_tokens: int = 4096, max_documents: int | None = None,
         max_cost: float | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.2, 0.2),
         group_pieces: int = 16_384) -> DataFrame:
    """Add (sequence_id, offset) to pieces with a ``length`` column."""
    capacity = (float(max_tokens), float(max_documents or max_tokens), float(max_cost or max_tokens ** 2))
    total = pieces.count()
    groups = max(1, -(-total // group_pieces))
    keys = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    # the random part tells equal rows apart, so copies spread over the groups too
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(*keys, F.rand(17)), F.lit(groups)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def place(key, table):
        table = table.sort_by([("length", "descending"), *((k, "ascending") for k in keys)])
        bins, offsets = best_fit(table["length"].to_numpy(), capacity, weights, rule)
        group = key[0].as_py()
        return table.drop(["_group"]).append_column("sequence_id", pa.array(bins + (group << 32))) \
                    .append_column("offset", pa.array(offsets))

    return dealt.groupBy("_group").applyInArrow(place, schema + ", sequence_id long, offset long")
