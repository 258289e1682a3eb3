"""Byte-level BPE through sentencepiece, without a converted model file.

The vocabulary (lines of base64 bytes and rank) is serialised directly as a
sentencepiece BPE model: byte ``b`` is written as the character U+0100 + b,
each vocabulary entry is a piece scored by its negative rank, and the
normaliser is the identity.  Sentencepiece merges the adjacent pair with the
highest score, the leftmost of equals, which is the lowest-rank merge of the
byte-level scheme.  A pre-token that is itself an entry takes that entry.

Texts are cut before every run of ASCII white space that follows another
character; the pattern never matches across such a cut, so each distinct cut
is split by the pattern and encoded once per slice.  Decoding maps the ids
back to pieces and the pieces back to bytes.

Edge cases: a null or empty text has no tokens (hashes of the empty string);
repeated rows give equal rows; other columns are ignored; an empty table gives
an empty result; long texts are encoded whole.  The vocabulary is read where
the task runs (its path must exist on the executors).
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

FIRST_CHAR = 0x100


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def as_piece(raw: bytes) -> str:
    return "".join(chr(FIRST_CHAR + b) for b in raw)


def as_bytes(piece: str) -> bytes:
    return bytes(ord(c) - FIRST_CHAR for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One protobuf field: int as varint, float as 32 bits, bytes with length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model; piece id = rank order + 1 (0 is unknown)."""
    # Field numbers of sentencepiece_model.proto (ModelProto:
    # pieces 1, trainer_spec 2, normalizer_spec 3; SentencePiece: piece 1,
    # score 2, type 3 with NORMAL 1 and UNKNOWN 2; TrainerSpec: model_type 3
    # with BPE 2, vocab_size 4, unk/bos/eos/pad ids 40-43; NormalizerSpec:
    # name 1, add_dummy_prefix 3, remove_extra_whitespaces 4,
    # escape_whitespaces 5).
    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind))

    out = [piece("<unk>", 0.0, 2)]
    out += [piece(as_piece(raw), -float(rank), 1) for raw, rank in sorted(ranks.items(), key=lambda x: x[1])]
    out.append(_field(2, _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, 0)
                      + b"".join(_field(k, -1) for k in (41, 42, 43))))
    out.append(_field(3, _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder of one vocabulary file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        # white space as Unicode's White_Space property, whatever \s means here
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}")
                                     .replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        order = sorted(self.ranks.values())
        self.rank_of_id = np.array([-1, *order], np.int64)
        pieces = [b"", *(as_bytes(self.model.id_to_piece(i)) for i in range(1, len(order) + 1))]
        self.bytes_of_id = A.Ragged.of(pieces)
        self.digits_of_id = A.Ragged.of([b"", *(b"%d " % rank for rank in order)])
        self.id_of_rank = {rank: i for i, rank in enumerate(order, 1)}

    def encode_pretokens(self, pretokens: list[bytes]) -> list[list[int]]:
        """Piece ids of every pre-token, each on its own."""
        out: list = [None] * len(pretokens)
        rest = []
        for i, raw in enumerate(pretokens):
            rank = self.ranks.get(raw)
            if rank is None:
                rest.append(i)
            else:
                out[i] = (self.id_of_rank[rank],)
        if rest:
            raw = A.Ragged.of([pretokens[i] for i in rest])
            chars = (raw.flat.astype("<u2") + FIRST_CHAR).tobytes().decode("utf-16-le")
            ends = (raw.starts + raw.lengths).tolist()
            coded = self.model.encode([chars[a:b] for a, b in zip(raw.starts.tolist(), ends)],
                                      out_type=int, num_threads=1)
            for i, ids in zip(rest, coded):
                out[i] = ids
        return out

    def encode_spans(self, spans: list[bytes]) -> A.Ragged:
        """Piece ids of texts, each split by the pattern."""
        raw = A.Ragged.of(spans)
        # one optional blank, then unaccented letters only: a single match
        other = ~PLAIN_LETTERS[raw.flat]
        other[raw.starts[raw.lengths > 1]] &= raw.flat[raw.starts[raw.lengths > 1]] != 32
        seen = np.concatenate([[0], np.cumsum(other)])
        plain = (seen[raw.starts + raw.lengths] == seen[raw.starts]).tolist()
        tokens: list[bytes] = []
        counts = np.ones(len(spans), np.int64)
        for i, span in enumerate(spans):
            if plain[i]:
                tokens.append(span)
            else:
                found = self.pattern.findall(span.decode())
                counts[i] = len(found)
                tokens += [m.encode() for m in found]
        distinct = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        coded = self.encode_pretokens(list(distinct))
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(itertools.chain.from_iterable(coded), np.int32, int(lengths.sum()))
        which = np.fromiter((distinct[t] for t in tokens), np.int64, len(tokens))
        return A.Ragged(flat, lengths).take(which).grouped(counts)

    def describe(self, spans: list[bytes]) -> list[A.Ragged]:
        """Columns of a SpanTable: ids, their decimals, the decoded bytes."""
        ids = self.encode_spans(spans)
        return [ids, self.digits_of_id.take(ids.flat).grouped(ids.lengths),
                self.bytes_of_id.take(ids.flat).grouped(ids.lengths)]

    def encode(self, text: bytes) -> list[int]:
        return self.rank_of_id[self.encode_spans([text]).flat].tolist()

    def decode(self, ranks: list[int]) -> bytes:
        return self.bytes_of_id.take(np.array([self.id_of_rank[r] for r in ranks], np.int64)).flat.tobytes()


PLAIN_LETTERS = A.byte_mask(bytes([*range(65, 91), *range(97, 123)]))


# ASCII white space, and the last bytes (UTF-8) of the other
# characters of the White_Space property.
_WIDE_BLANKS = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def cuts(buf: np.ndarray) -> np.ndarray:
    """Positions before which a text may be cut: ASCII blanks after a non-blank."""
    blank = A.byte_mask(A.BLANKS)[buf]
    after = np.zeros(len(buf), bool)
    after[1:] = blank[:-1]
    at = np.flatnonzero(blank & ~after)
    at = at[at > 0]
    wide = np.zeros(len(at), bool)
    for c in _WIDE_BLANKS:
        tail = chr(c).encode()
        fits = at >= len(tail)
        for k, b in enumerate(reversed(tail), 1):
            fits &= buf[np.maximum(at - k, 0)] == b
        wide |= fits
    return at[~wide]


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = A.per_worker(("byte_bpe", vocabulary, pattern), lambda: ByteBpe(vocabulary, pattern))
        table = A.per_worker(("byte_bpe spans", vocabulary, pattern), lambda: A.SpanTable(bpe.describe))
        for rows, buf, off in A.slices(batches, "text"):
            # a span runs from one cut or text edge to the next, without the
            # line feed that closes a text
            starts = np.unique(np.concatenate([cuts(buf), off[:-1]]))
            starts = starts[starts < off[np.searchsorted(off, starts, "right")] - 1]
            ends = np.append(starts[1:], off[-1])
            ends = np.minimum(ends, off[np.searchsorted(off, starts, "right")] - 1)
            first = np.searchsorted(starts, off)
            which, (ids, digits, raw) = table.find(buf, starts, ends)
            total = np.concatenate([[0], np.cumsum(ids.lengths[which])])[first]
            out = [rows.column(0), pa.array(np.diff(total))]
            for column, closing in ((digits, 1), (raw, 0)):
                one = column.take(which)
                edge = np.concatenate([[0], np.cumsum(one.lengths)])[first].tolist()
                view = memoryview(one.flat)
                out.append(pa.array([hashlib.sha256(view[a:max(a, b - closing)]).hexdigest()
                                     for a, b in zip(edge, edge[1:])]))
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(
                    bpe.rank_of_id[ids.take(which).flat].astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
                           + ", ids array<int>" * with_ids)
