"""Polynomial hashes of byte stretches, for all stretches of a buffer at once."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Random 64-bit value of each byte (fixed seed).
BYTES = np.random.default_rng(20_240_602).integers(1, 2**63, 256, dtype=np.uint64)
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(name: str, base: np.uint64, size: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; kept by the worker."""
    have = _powers.get(name)
    if have is None or len(have) < size:
        steps = np.full(max(size, 1 << 18), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:size]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``stretch`` reads the hash of any stretch of ``data``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers("up", BASE, len(data)), out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever the bytes stand."""
    return mix((sums[end] - sums[start]) * powers("down", _INVERSE, len(sums))[start])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
