"""Suffix arrays by two-stage sorting, and adjacent common prefixes, for blocks of text."""

from __future__ import annotations

import numpy as np

#: Stands between strings of a block; no UTF-8 text holds this byte.
SEPARATOR = 255


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For every suffix, whether it is smaller than its successor; the last one is not."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    # within a run of equal bytes the end of the run decides
    last = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(last[::-1])[::-1]] > 0


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """All wanted suffixes in order of their first ``depth`` bytes or more.

    ``wanted`` marks suffixes; whenever one is larger than its successor, the
    successor must be wanted too.

    Suffixes smaller than their successors are sorted directly. Every other one
    is larger than its successor, so a scan over the buckets of first bytes,
    in order, meets its successor first and appends it to its own bucket: within
    a bucket those induced ones stand before the directly sorted ones.
    """
    n = len(text)
    small = smaller_than_next(text)
    wanted = np.ones(n, bool) if wanted is None else wanted
    direct, induced = np.flatnonzero(small & wanted), wanted & ~small
    plain = text.tobytes().decode("latin-1")
    keys = [plain[i : i + depth] for i in direct.tolist()]
    rank = {k: r for r, k in enumerate(sorted(set(keys)))}
    direct = direct[np.argsort(np.fromiter(map(rank.__getitem__, keys), np.int64, len(keys)), kind="stable")]
    bounds = np.searchsorted(text[direct], np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray, at: int) -> np.ndarray:
        """Append the larger predecessors of ``found`` to their buckets; return those of bucket ``at``."""
        before = found[found > 0] - 1
        before = before[induced[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        own = before[:0]
        for part in np.split(before, cuts) if len(before) else []:
            b = int(text[part[0]])
            if b == at:
                own = part
            else:
                buckets[b].append(part)
        return own

    out: list[np.ndarray] = []
    if wanted[-1]:
        buckets[int(text[-1])].append(np.array([n - 1]))  # the successor of the last suffix is the empty one
    for b in range(256):
        wave = np.concatenate(buckets[b]) if buckets[b] else direct[:0]
        while len(wave):  # a run of equal bytes takes one wave for each byte
            out.append(wave)
            wave = induce(wave, b)
        sorted_ones = direct[bounds[b] : bounds[b + 1]]
        if len(sorted_ones):
            out.append(sorted_ones)
            induce(sorted_ones, -1)
    return np.concatenate(out) if out else direct


def needed(text: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The suffixes of ``whole``, and behind each those that induce it: up to the next one smaller than its successor."""
    at = np.arange(len(text))
    stop = np.minimum.accumulate(np.where(smaller_than_next(text), at, len(text) - 1)[::-1])[::-1]
    marks = np.zeros(len(text) + 1, np.int64)
    np.add.at(marks, at[whole], 1)
    np.add.at(marks, stop[whole] + 1, -1)
    return np.cumsum(marks[:-1]) > 0


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix of ``order`` shares ``depth`` bytes with the one before it. False for the first."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.zeros(len(padded) - 7, np.uint64)  # the eight bytes from each place on
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : len(words) + i]
    alive = np.arange(1, len(order))
    for at in range(0, depth - 7, 8):
        alive = alive[words[order[alive] + at] == words[order[alive - 1] + at]]
    for at in range(depth - depth % 8, depth):
        alive = alive[padded[order[alive] + at] == padded[order[alive - 1] + at]]
    same = np.zeros(len(order), bool)
    same[alive] = True
    return same


def repeated_windows(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string, which of its ``width``-byte windows occur again in the block."""
    sizes = np.array([len(s) + 1 for s in strings])
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(strings)), sizes)
    offset = np.arange(len(text)) - starts[owner]
    whole = offset + width < sizes[owner]  # the window ends before the separator
    order = suffix_array(text, width, needed(text, whole))
    order = order[whole[order]]
    same = common_prefixes(text, order, width)
    again = same | np.append(same[1:], False)
    flags = np.zeros(len(text), bool)
    flags[order] = again
    return [flags[a : a + max(0, n - width)] for a, n in zip(starts.tolist(), sizes.tolist())]
