"""Batch helpers shared by the operators: Arrow text columns as flat numpy
byte buffers, word spans and 64-bit hashes of byte spans.

All of it is vectorised over a slice of at most ``max_bytes`` of text (a
longer single text forms a slice of its own), so the memory of a task does
not depend on the size of its partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

# byte classes of the contracts (ASCII; bytes from 0x80 on belong to words)
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32


def release() -> None:
    """Give what this Python worker freed back to the system: the worker lives on
    beside others, and its allocators would keep the largest size it ever had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, for work that turns rows into objects."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


def slices(batches: Iterator[pa.RecordBatch], column: str,
           max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yield (rows, bytes, offsets) with every text followed by a line feed.

    Text ``i`` is ``bytes[offsets[i]:offsets[i + 1] - 1]``; null texts are
    empty.  The line feed keeps words of neighbouring texts apart.
    """
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
        if col.null_count:
            col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
        n = len(col)
        if not n:
            continue
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
            end = min(end, n)
            local = off[at:end + 1] - off[at]
            buf = np.insert(data[off[at]:off[end]], local[1:], 10)
            yield batch.slice(at, end - at), buf, local + np.arange(end - at + 1)
            at = end
    # the batches of a long partition are not kept by the worker
    release()


def byte_mask(members: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(members)] = True
    return mask


def word_spans(buf: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that separate nothing."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~separators[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the first word of every text, plus the total at the end."""
    return np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, at least ``n``."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64),
                                                   np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                        for b in (_BASE, inverse))
        _POWERS.clear()
        _POWERS[size] = (up, down)
    return _POWERS[size]


def _byte_codes(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x1000003)) | np.uint64(1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of every span (bytes or code points), equal for equal
    content wherever it stands."""
    up, down = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        codes = _byte_codes(seed)[buf] if buf.dtype == np.uint8 else mix64(buf + np.uint64(seed << 32)) | np.uint64(1)
        np.cumsum(codes * up[:len(buf)], out=total[1:], dtype=np.uint64)
        value = (total[ends] - total[starts]) * down[starts]
        return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_of(word: bytes, seed: int = 1) -> int:
    buf = np.frombuffer(word, np.uint8)
    return int(span_hashes(buf, np.zeros(1, np.int64), np.array([len(buf)]), seed)[0])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int, seed: int = 7) -> list[np.ndarray]:
    """Distinct sorted shingle hashes of every text.

    ``words`` are word hashes, ``first`` the first word of every text (with
    the end).  A text of fewer than ``width`` words has one shingle, the
    whole sequence; a text without words none.
    """
    n = len(words)
    with np.errstate(over="ignore"):
        rolled = np.full(max(0, n - width + 1), seed, np.uint64)
        for k in range(width):
            rolled = (rolled + words[k:n - width + 1 + k]) * np.uint64(0xD1342543DE82EF95)
            rolled ^= rolled >> np.uint64(29)
        rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            value = np.uint64(seed + int(b - a))
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    value = (value + w) * np.uint64(0xD1342543DE82EF95)
                    value ^= value >> np.uint64(29)
            out.append(mix64(np.array([value])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest128(values: np.ndarray) -> bytes:
    """128-bit fingerprint of an array's bytes."""
    import xxhash

    return xxhash.xxh3_128(values.tobytes()).digest()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


class Ragged:
    """Lists of different lengths in one flat array."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, np.asarray(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @classmethod
    def of(cls, lists: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(lists), np.uint8), np.fromiter(map(len, lists), np.int64, len(lists)))

    def take(self, which: np.ndarray) -> Ragged:
        lengths = self.lengths[which]
        return Ragged(self.flat[ragged(self.starts[which], lengths)], lengths)

    def grouped(self, counts: np.ndarray) -> Ragged:
        """Join every ``counts[i]`` consecutive lists into one."""
        edge = np.concatenate([[0], np.cumsum(self.lengths)])
        return Ragged(self.flat, np.diff(edge[np.concatenate([[0], np.cumsum(counts)])]))

    def __add__(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, other.flat]), np.concatenate([self.lengths, other.lengths]))


class SpanTable:
    """What ``make`` says about distinct byte spans, kept over the slices.

    ``make(spans)`` returns Ragged columns with one list per span.  Spans are
    told apart by a 64-bit hash.  Beyond ``limit`` spans the table starts
    afresh, so its memory is bounded.
    """

    def __init__(self, make, limit: int = 400_000):
        self.make, self.limit = make, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows, self.columns = np.empty(0, np.uint64), np.empty(0, np.int64), None

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[Ragged]]:
        """Row of every span, and the columns."""
        keys, first, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        for _ in range(2):
            at = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), bool)
            there = at < len(self.keys)
            new[there] = self.keys[at[there]] != keys[there]
            if len(self.keys) == 0 or len(self.keys) + new.sum() <= self.limit:
                break
            self.clear()
        if new.any() or self.columns is None:
            raw = buf.tobytes()
            made = self.make([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            rows = len(self.keys) + np.arange(int(new.sum()))
            self.rows = np.insert(self.rows, at[new], rows)
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.columns = made if self.columns is None else [a + b for a, b in zip(self.columns, made)]
            at = np.searchsorted(self.keys, keys)
        return self.rows[at][which], self.columns


def claimed(operator: str) -> dict:
    """What ``operator`` keeps in this Python worker between its tasks.

    What another operator left there goes first: a worker that serves the
    stages of a pipeline holds one operator's tables.
    """
    import sys
    import types

    module = sys.modules.setdefault("_ledgerline_worker", types.ModuleType("_ledgerline_worker"))
    if getattr(module, "operator", None) != operator:
        module.operator, module.kept = operator, {}
        release()
    return module.kept


def per_worker(key, make):
    """``make()``, kept in the Python worker for its operator's later tasks.

    The first word of a key names the operator.
    """
    kept = claimed(key[0].split()[0])
    if key not in kept:
        kept[key] = make()
    return kept[key]
