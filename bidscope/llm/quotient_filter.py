"""Counting quotient filters over packed word-id n-grams, with nothing lost.

A key is an n-gram of word ids, ``bits`` bits each, packed into two halves of
``half`` bits.  ``permute`` mixes the halves by a Feistel network, which is
invertible, so a mixed key is as good as the n-gram itself and spreads evenly.
Its leading bits number a shard of the key space; within a shard a filter
takes the next bits as the quotient and keeps all the others as the remainder.

``Counts`` holds mixed keys in order with their counts; ``encode`` writes them
as a filter: one bit per quotient (occupied or not), one bit per entry (last
of its run), the remainders at their byte width, and counters of one byte with
a list for larger ones.  ``decode`` gives the same ``Counts`` back.  Sorted
filters are merged by merging their entries, so filters of any number of
shards or tasks add up to the filter of all their keys.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

# Both halves of a key fit 64 bits.
MAX_KEY_BITS = 128

_ROUNDS = tuple(np.uint64(c) for c in (
    0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_HEAD = struct.Struct("<QBBBBQ")


def half_bits(bits: int, n: int) -> int:
    """Width of each half of the keys of ``n`` ids of ``bits`` bits."""
    total = bits * n
    if total > MAX_KEY_BITS:
        raise ValueError(f"{n} ids of {bits} bits are more than {MAX_KEY_BITS} bits")
    return (total + 1) // 2


def _low(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def _round(x: np.ndarray, k: int, half: int) -> np.ndarray:
    x = (x + _ROUNDS[k]) * _ROUNDS[(k + 1) % 4]
    x ^= x >> np.uint64(31)
    x *= _ROUNDS[(k + 2) % 4]
    return x >> np.uint64(64 - half)


def pack(ids: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the n-grams whose k-th ids are ``ids[k]``; the first
    id stands in the highest bits."""
    half = half_bits(bits, len(ids))
    high = np.zeros(len(ids[0]), np.uint64)
    low = high.copy()
    at = bits * len(ids)
    for column in ids:
        at -= bits
        value = column.astype(np.uint64)
        if at >= half:
            high |= value << np.uint64(at - half)
        else:
            low |= (value << np.uint64(at)) & _low(half)
            if at + bits > half:
                high |= value >> np.uint64(half - at)
    return high, low


def unpack(high: np.ndarray, low: np.ndarray, bits: int, n: int) -> list[np.ndarray]:
    half = half_bits(bits, n)
    out = []
    for k in range(n):
        at = bits * (n - 1 - k)
        if at >= half:
            value = high >> np.uint64(at - half)
        else:
            value = low >> np.uint64(at)
            if at + bits > half:
                value = value | (high << np.uint64(half - at))
        out.append((value & _low(bits)).astype(np.int64))
    return out


def permute(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for k in range(4):
        if k % 2 == 0:
            high = high ^ _round(low, k, half)
        else:
            low = low ^ _round(high, k, half)
    return high, low


def restore(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for k in (3, 2, 1, 0):
        if k % 2 == 0:
            high = high ^ _round(low, k, half)
        else:
            low = low ^ _round(high, k, half)
    return high, low


@dataclass
class Counts:
    """Distinct mixed keys in ascending order and their counts."""

    high: np.ndarray
    low: np.ndarray
    n: np.ndarray
    half: int

    def __len__(self) -> int:
        return len(self.n)

    def slice(self, first: int, last: int) -> Counts:
        return Counts(self.high[first:last], self.low[first:last], self.n[first:last], self.half)


def merge(parts: list[Counts]) -> Counts:
    """The sum of sorted parts."""
    half = parts[0].half
    high, low, n = (np.concatenate([getattr(p, name) for p in parts])
                    for name in ("high", "low", "n"))
    if len(high) == 0:
        return Counts(high, low, n, half)
    if 2 * half <= 64:
        order = np.argsort((high << np.uint64(half)) | low, kind="stable")
    else:
        order = np.lexsort((low, high))
    high, low, n = high[order], low[order], n[order]
    first = np.flatnonzero(np.concatenate(
        [[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return Counts(high[first], low[first], np.add.reduceat(n, first), half)


def count(high: np.ndarray, low: np.ndarray, half: int) -> Counts:
    """Counts of mixed keys in any order."""
    if 2 * half <= 64:
        both, n = np.unique((high << np.uint64(half)) | low, return_counts=True)
        return Counts(both >> np.uint64(half), both & _low(half), n, half)
    return merge([Counts(high, low, np.ones(len(high), np.int64), half)])


def shard_ends(counts: Counts, shard_bits: int) -> np.ndarray:
    """Where each of the ``2 ** shard_bits`` shards begins, and the end."""
    shards = np.arange(1, 1 << shard_bits, dtype=np.uint64) << np.uint64(counts.half - shard_bits)
    return np.concatenate([[0], np.searchsorted(counts.high, shards), [len(counts)]])


def _to_bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_bytes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def encode(counts: Counts, shard_bits: int) -> bytes:
    """The filter of one shard's counts (not empty)."""
    n, half = len(counts), counts.half
    local = half - shard_bits
    q = min(local, max(0, int(n - 1).bit_length()))
    inner = counts.high & _low(local)
    quotient = inner >> np.uint64(local - q)
    shard = int(counts.high[0]) >> local
    occupied = np.zeros(1 << q, bool)
    occupied[quotient.astype(np.int64)] = True
    last = np.concatenate([quotient[1:] != quotient[:-1], [True]])
    wide = (local - q + 7) // 8
    narrow = (half + 7) // 8
    small = np.minimum(counts.n, 255).astype(np.uint8)
    return b"".join((
        _HEAD.pack(n, half, shard_bits, q, 0, shard), np.packbits(occupied).tobytes(),
        np.packbits(last).tobytes(), _to_bytes(inner & _low(local - q), wide),
        _to_bytes(counts.low, narrow), small.tobytes(),
        np.ascontiguousarray(counts.n[counts.n >= 255], "<i8").tobytes()))


def decode(data: bytes) -> Counts:
    n, half, shard_bits, q, _, shard = _HEAD.unpack_from(data)
    local = half - shard_bits
    wide, narrow = (local - q + 7) // 8, (half + 7) // 8
    at = _HEAD.size

    def take(size: int) -> bytes:
        nonlocal at
        at += size
        return data[at - size:at]

    occupied = np.unpackbits(np.frombuffer(take(((1 << q) + 7) // 8), np.uint8), count=1 << q)
    last = np.unpackbits(np.frombuffer(take((n + 7) // 8), np.uint8), count=n)
    run = np.cumsum(last) - last
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run]
    inner = (quotient << np.uint64(local - q)) | _from_bytes(take(n * wide), n, wide)
    low = _from_bytes(take(n * narrow), n, narrow)
    counts = np.frombuffer(take(n), np.uint8).astype(np.int64)
    large = counts == 255
    counts[large] = np.frombuffer(take(8 * int(large.sum())), "<i8")
    return Counts(inner | np.uint64(shard << local), low, counts, half)
