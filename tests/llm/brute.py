"""Plain single-process versions of the operators, and awkward documents."""

import collections
import hashlib
import random
import re

import numpy as np

CLASHING = "doc_id long, text string, id long, tid string, n int, gid string, comp string, spans int, kept string, `a.b` int"


def documents(seed=3, n=220):
    """Texts with copies, near copies, shared passages, ties, nulls and very long ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghäö") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    passages = [" ".join(rng.choice(words) for _ in range(k)) for k in (20, 38, 60, 150)]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 40, 150, 300])))
        if rng.random() < 0.4:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(passages) + text[at:]
        out.append((i, text if rng.random() < 0.97 else None))
    for i in range(n, n + 40):
        text = (out[rng.randrange(n)][1] or "").split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    return [*out, (9000, "Ab " * 60_000), (9001, "aB " * 59_000), (9002, "a" * 1000), (9003, "ab" * 700), (9004, "q" * 200), (9005, "q" * 199),
            (5, out[6][1]), (5, out[5][1]), (9006, ""), (9007, " \n "), (9008, "\x00 $ 12")]


def frame(spark, rows, parts=5):
    """The rows with extra columns whose names clash with the operators' own."""
    wide = [(*r, 1, "x", 2, "y", "z", 3, "k", 4) for r in rows]
    return spark.createDataFrame(wide, CLASHING).repartition(parts)


def shingle_sets(rows, width):
    out = []
    for _, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def components(rows, percent, width):
    """(id, set size, smallest id reachable) of every row."""
    sets = shingle_sets(rows, width)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    common = collections.Counter((a, b) for v in holders.values() for i, b in enumerate(v) for a in v[:i])
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            root[find(a)] = find(b)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), rows[k]), (rows[k][0], rows[k][1] or ""), key=lambda r: r[0])
    return sorted((rows[k][0], len(sets[k]), least[find(k)][0]) for k in range(len(rows)))


def covered(rows, width=200):
    """For every row, which bytes lie in a window that occurs again."""
    data = [(t or "").encode() for _, t in rows]
    count = collections.Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                edge[i] += 1
                edge[i + width] -= 1
        out.append(np.cumsum(edge)[: len(b)] > 0)
    return data, out


def repeats(rows, width=200):
    """(id, bytes, removed, spans, hash of the rest) of every row."""
    done = []
    for (i, _), b, gone in zip(rows, *covered(rows, width)):
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        done.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(done)
