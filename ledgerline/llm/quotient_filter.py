"""Counting quotient filters over packed word-id n-grams, without loss.

An n-gram of ``n`` word ids of ``bits`` bits each is a key of ``n * bits`` bits,
held in two halves.  A keyed Feistel network permutes the keys among themselves
(each half is changed by exclusive or with a mix of the other, so every round
is its own inverse); the permuted keys are spread evenly, whatever the words.
The topmost bits of a permuted key name its part (a shuffle key), the next its
quotient inside the part; everything below is the remainder and is stored in
full, so keys are recovered exactly and no two of them ever share a counter.

A filter is one part of one shard: the entries in key order, the quotients as
unary run lengths (about two bits an entry), the remainders in whole bytes, the
counters in one byte with a list of the larger ones.  Filters of one part are
merged in key order by adding the counters of equal keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import arrays as A

ROUNDS = 4
LARGE = 255  # a counter byte that points to the list of large counters


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _u64(x: int) -> np.uint64:
    return np.uint64(x)


@dataclass(frozen=True)
class Shape:
    """n-grams of ``n`` ids of ``bits`` bits, dealt into ``1 << part_bits`` parts."""
    n: int
    bits: int
    part_bits: int

    @property
    def left_bits(self) -> int:
        return self.bits * ((self.n + 1) // 2)

    @property
    def right_bits(self) -> int:
        return self.bits * (self.n // 2)

    def permute(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the permuted keys of n-grams given as n columns."""
        half = (self.n + 1) // 2
        left, right = (_pack(words[:half], self.bits), _pack(words[half:], self.bits))
        for k in range(ROUNDS):
            right = right ^ (A.mix64(left + _u64(2 * k + 1)) & _mask(self.right_bits))
            left = left ^ (A.mix64(right + _u64(2 * k + 2)) & _mask(self.left_bits))
        return left, right

    def invert(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        for k in reversed(range(ROUNDS)):
            left = left ^ (A.mix64(right + _u64(2 * k + 2)) & _mask(self.left_bits))
            right = right ^ (A.mix64(left + _u64(2 * k + 1)) & _mask(self.right_bits))
        half = (self.n + 1) // 2
        return _unpack(left, half, self.bits) + _unpack(right, self.n - half, self.bits)

    def part(self, left: np.ndarray) -> np.ndarray:
        return (left >> _u64(self.left_bits - self.part_bits)).astype(np.int64)

    def sorted(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray):
        """The distinct keys in order, with the sums of their counters."""
        if not len(left):
            return left, right, counts
        if self.left_bits + self.right_bits <= 64:
            # a stable sort merges runs that are in order already
            order = np.argsort(left << _u64(self.right_bits) | right, kind="stable")
        else:
            order = np.lexsort((right, left))
        left, right, counts = left[order], right[order], counts[order]
        first = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        at = np.flatnonzero(first)
        return left[at], right[at], np.add.reduceat(counts, at)


def _pack(words: list[np.ndarray], bits: int) -> np.ndarray:
    out = words[0].astype(np.uint64)
    for w in words[1:]:
        out = out << _u64(bits) | w.astype(np.uint64)
    return out


def _unpack(half: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    return [half >> _u64(bits * (n - 1 - k)) & _mask(bits) for k in range(n)]


def _to_bytes(x: np.ndarray, bits: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)].tobytes()


def _from_bytes(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :-(-bits // 8)] = raw.reshape(n, -1)
    return out.view("<u8").ravel().astype(np.uint64)


def encode(shape: Shape, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of sorted distinct keys, all of one part."""
    n = len(left)
    below = shape.left_bits - shape.part_bits
    q = min(below, max(0, n.bit_length() - 1))
    rest = below - q
    inner = left & _mask(below)
    runs = np.bincount((inner >> _u64(rest)).astype(np.int64), minlength=1 << q)
    unary = np.ones(n + len(runs), np.uint8)
    unary[np.cumsum(runs) + np.arange(len(runs))] = 0
    large = np.flatnonzero(counts >= LARGE)
    return b"".join([
        np.array([n, q, len(large)], "<i8").tobytes(), np.packbits(unary).tobytes(),
        _to_bytes(inner & _mask(rest), rest), _to_bytes(right, shape.right_bits),
        np.minimum(counts, LARGE).astype(np.uint8).tobytes(),
        large.astype("<i8").tobytes(), counts[large].astype("<i8").tobytes()])


def decode(shape: Shape, part: int, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order (both halves) and counters of a filter of ``part``."""
    data = np.frombuffer(raw, np.uint8)
    n, q, n_large = (int(v) for v in data[:24].view("<i8"))
    at = 24

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return data[at - size:at]

    below = shape.left_bits - shape.part_bits
    rest = below - q
    unary = np.unpackbits(take(-(-(n + (1 << q)) // 8)), count=n + (1 << q))
    quotient = np.cumsum(unary == 0)[unary == 1].astype(np.uint64)
    left = quotient << _u64(rest) | _from_bytes(take(n * -(-rest // 8)), n, rest)
    right = _from_bytes(take(n * -(-shape.right_bits // 8)), n, shape.right_bits)
    counts = take(n).astype(np.int64)
    where = np.frombuffer(take(8 * n_large).tobytes(), "<i8")
    counts[where] = np.frombuffer(take(8 * n_large).tobytes(), "<i8")
    return left | _u64(part) << _u64(below), right, counts


def shards(shape: Shape, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes]]:
    """(part, filter) of sorted distinct keys of any parts."""
    part = shape.part(left)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, int)
    return [(int(part[a]), encode(shape, left[a:b], right[a:b], counts[a:b])) for a, b in zip(edges[:-1], edges[1:])]


def merged(shape: Shape, part: int, filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One part's keys over all shards, counters of equal keys added."""
    pieces = [decode(shape, part, raw) for raw in filters]
    return shape.sorted(*(np.concatenate(column) for column in zip(*pieces)))
