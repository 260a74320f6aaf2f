"""Sets of hashed word shingles of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from rootseek.llm import rolling

#: Bytes hashed at once; a longer text goes in pieces.
BYTES = 1 << 18
#: Word separators: blank and the control characters 9 to 13.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CUT = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def pieces(data: bytes) -> Iterator[bytes]:
    """Stretches of about ``BYTES`` bytes, cut at separators."""
    at = 0
    while len(data) - at > BYTES:
        ends = [e for e in (data.find(c, at + BYTES) for c in _CUT) if e >= 0]
        end = min(ends, default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text) for texts of about ``BYTES`` bytes together."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = SEPARATOR[data]
    before = np.concatenate([[True], gap[:-1]])
    start = np.flatnonzero(before & ~gap)
    end = np.flatnonzero(gap & ~before)
    hashes = rolling.stretch(rolling.prefix_sums(LOWER[data]), start, end)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, bounds), prepend=0)


def _combine(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = total * rolling.BASE + words[i : len(words) - n + 1 + i]
    return rolling.mix(total + np.uint64(n))


def set_of(words: np.ndarray, width: int) -> np.ndarray:
    """Ascending distinct shingle hashes; a shorter text is one shingle, one without words none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    found = np.sort(_combine(words, min(width, len(words))))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The shingle set of every text, in order."""
    group, size = [], 0

    def settle():
        hashes, counts = word_hashes(group)
        at = 0
        for n in counts.tolist():
            yield set_of(hashes[at : at + n], width)
            at += n

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if group and size + len(data) > BYTES:
            yield from settle()
            group, size = [], 0
        if len(data) > BYTES:
            yield set_of(np.concatenate([word_hashes([p])[0] for p in pieces(data)]), width)
        else:
            group.append(data)
            size += len(data)
    if group:
        yield from settle()
