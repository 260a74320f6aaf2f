"""Lossless counting quotient filters of packed id sequences.

A sequence of up to four ids is packed into two halves of ``width`` bits each. A Feistel
network, which can be undone, permutes the packed number; its top bits tell the
shard, the next ones the quotient, and all others are kept as the remainder,
so a filter holds its entries exactly and merging loses nothing. A filter is
sorted: one bit string tells how many entries each quotient has (a one for an
entry, a zero for the end of a quotient), remainders and counts follow in order.
Counts take one byte, larger ones are listed apart.
"""

from __future__ import annotations

import numpy as np

#: Multipliers of the rounds (fixed, odd).
KEYS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
ESCAPE = 255

Keys = tuple[np.ndarray, np.ndarray]


def width(id_bits: int, n: int) -> int:
    """Bits of each half for sequences of n ids."""
    return id_bits * ((n + 1) // 2)


def pack(ids: list[np.ndarray], id_bits: int) -> Keys:
    """The two halves of sequences given by place."""
    half = len(ids) // 2
    halves = []
    for part in (ids[:half], ids[half:]):
        total = np.zeros(len(ids[0]), np.uint64)
        for x in part:
            total = (total << np.uint64(id_bits)) | x.astype(np.uint64)
        halves.append(total)
    return halves[0], halves[1]


def unpack(keys: Keys, id_bits: int, n: int) -> list[np.ndarray]:
    """The ids by place."""
    mask, out = np.uint64((1 << id_bits) - 1), []
    for total, size in zip(keys, (n // 2, n - n // 2)):
        out += [((total >> np.uint64(id_bits * i)) & mask).astype(np.int64) for i in range(size - 1, -1, -1)]
    return out


def _round(x: np.ndarray, key: np.uint64, bits: int) -> np.ndarray:
    x = (x + key) * key
    x ^= x >> np.uint64(32)
    x *= KEYS[1]
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - bits)


def permute(keys: Keys, bits: int) -> Keys:
    hi, lo = keys
    for i in (0, 2):
        hi = hi ^ _round(lo, KEYS[i], bits)
        lo = lo ^ _round(hi, KEYS[i + 1], bits)
    return hi, lo


def restore(keys: Keys, bits: int) -> Keys:
    hi, lo = keys
    for i in (2, 0):
        lo = lo ^ _round(hi, KEYS[i + 1], bits)
        hi = hi ^ _round(lo, KEYS[i], bits)
    return hi, lo


def mark(keys: Keys) -> np.ndarray:
    """A 62-bit hash of permuted keys, for one-sided membership tests."""
    return ((keys[0] * KEYS[2] + keys[1]) * KEYS[0] >> np.uint64(2)).astype(np.int64)


def _order(hi: np.ndarray, lo: np.ndarray, bits: int) -> np.ndarray:
    order = np.argsort(hi, kind="stable")
    hi, lo = hi[order], lo[order]
    same = hi[1:] == hi[:-1]
    mixed = same & (lo[1:] != lo[:-1])
    if mixed.any():  # few entries share half of the key: sort those runs by the other half
        run = np.concatenate([[0], np.cumsum(~same)])
        odd = np.flatnonzero(np.isin(run, run[1:][mixed]))
        order[odd] = order[odd][np.lexsort((lo[odd], hi[odd]))]
    return order


def counted(keys: Keys, counts: np.ndarray | None, bits: int) -> tuple[Keys, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (one each if not given)."""
    hi, lo = keys
    if not len(hi):
        return (hi, lo), np.zeros(0, np.int64)
    if counts is None and 2 * bits <= 64:
        joined = np.sort((hi << np.uint64(bits)) | lo)
        first = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]]))
        joined = joined[first]
        return (joined >> np.uint64(bits), joined & np.uint64((1 << bits) - 1)), np.diff(np.append(first, len(hi)))
    order = _order(hi, lo, bits)
    hi, lo = hi[order], lo[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    sums = np.diff(np.append(first, len(hi))) if counts is None else np.add.reduceat(counts[order], first)
    return (hi[first], lo[first]), sums.astype(np.int64)


def _planes(x: np.ndarray, bits: int) -> bytes:
    """Whole bytes of numbers of so many bits."""
    size = (bits + 7) // 8
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _from_planes(data: memoryview, n: int, bits: int) -> tuple[np.ndarray, int]:
    size = (bits + 7) // 8
    full = np.zeros((n, 8), np.uint8)
    full[:, :size] = np.frombuffer(data, np.uint8, n * size).reshape(n, size)
    return full.view("<u8").ravel(), n * size


def write(keys: Keys, counts: np.ndarray, bits: int, shard_bits: int) -> bytes:
    """A filter of sorted distinct permuted keys of one shard."""
    hi, lo = keys
    n, rest = len(hi), bits - shard_bits
    slots = min(rest, max(0, int(n).bit_length() - 1))
    inner = hi & np.uint64((1 << rest) - 1)
    quotient = (inner >> np.uint64(rest - slots)).astype(np.int64)
    ends = np.zeros(n + (1 << slots), bool)
    ends[quotient + np.arange(n)] = True
    small = np.minimum(counts, ESCAPE).astype(np.uint8)
    head = np.array([n, slots], "<i4").tobytes()
    remainder = _planes(inner & np.uint64((1 << (rest - slots)) - 1), rest - slots) + _planes(lo, bits)
    return head + np.packbits(ends).tobytes() + remainder + small.tobytes() + counts[small == ESCAPE].astype("<i8").tobytes()


def read(data: bytes, bits: int, shard_bits: int, shard: int) -> tuple[Keys, np.ndarray]:
    """The keys and counts of a filter."""
    view = memoryview(data)
    n, slots = np.frombuffer(view[:8], "<i4").tolist()
    at, size, rest = 8, (n + (1 << slots) + 7) // 8, bits - shard_bits
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(view[at : at + size], np.uint8), count=n + (1 << slots)))
    at += size
    low, used = _from_planes(view[at:], n, rest - slots)
    at += used
    lo, used = _from_planes(view[at:], n, bits)
    at += used
    hi = (np.uint64(shard) << np.uint64(rest)) | ((ends - np.arange(n)).astype(np.uint64) << np.uint64(rest - slots)) | low
    counts = np.frombuffer(view[at : at + n], np.uint8).astype(np.int64)
    counts[counts == ESCAPE] = np.frombuffer(view[at + n :], "<i8")
    return (hi, lo), counts


def shards(keys: Keys, counts: np.ndarray, bits: int, shard_bits: int) -> list[tuple[int, bytes]]:
    """Filters of sorted distinct keys by shard."""
    part = (keys[0] >> np.uint64(bits - shard_bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(part))
    return [(int(part[a]), write((keys[0][a:b], keys[1][a:b]), counts[a:b], bits, shard_bits)) for a, b in zip(first.tolist(), ends.tolist())]


def merge(filters: list[bytes], bits: int, shard_bits: int, shard: int) -> tuple[Keys, np.ndarray]:
    """Sorted distinct keys of filters of one shard, and the sums of their counts."""
    found = [read(f, bits, shard_bits, shard) for f in filters]
    keys = tuple(np.concatenate([k[i] for k, _ in found]) for i in (0, 1))
    return counted(keys, np.concatenate([c for _, c in found]), bits)
