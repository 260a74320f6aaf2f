"""Collocations against brute force, and quotient filters."""

import re
from collections import Counter

import numpy as np
import pytest

from rootseek.llm import collocations, quotient

SCHEMA = "doc_id long, text string, lang string, n long, ids int, word int, a int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, 1, 2, 3, 4) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(5)


def brute(rows, least, cover, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + n])) for n in range(1, 5) for i in range(len(w) - n + 1))
    cands = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, g), a in cands.items():
        for n in range(2, len(g)):
            for i in range(len(g) - n + 1):
                inside[lang, g[i : i + n]] = max(inside[lang, g[i : i + n]], a)
    out = {}
    for (lang, g), a in cands.items():
        if 100 * inside[lang, g] >= cover * a:
            continue
        cuts = [(2000000 * a // (counts[lang, g[:k]] + counts[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), counts[lang, g[:k]], counts[lang, g[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, totals[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def made(seed=1, n=120):
    rng = np.random.default_rng(seed)
    vocab = ["the", "The", "of", "a", "new", "york", "york's", "Île", "日本", "x\x1cy", "\x00", "city", "hall", "Ä", "ä", "é", "0", "-", "\xa0", "zz"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ";", " ? "]
    def text():
        size = rng.integers(0, 120)
        parts = [vocab[i % len(vocab)] + ends[j] for i, j in zip(rng.zipf(1.4, size), rng.integers(0, len(ends), size))]
        return "".join(parts) + ("new york city hall " * int(rng.integers(0, 4)))
    return [(text(), [None, "en", "en", "de", "und"][rng.integers(0, 5)]) for _ in range(n)]


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("small", [True, False])
def test_equals_brute_force(spark, monkeypatch, small):
    if not small:  # the dictionary by joins, many chunks, shards and filters
        monkeypatch.setattr(collocations, "SMALL_WORDS", 0)
        monkeypatch.setattr(collocations, "SHARD", 100)
    rows = made() + [("aa bb cc dd ee " * 500 + "ff", "en"), (None, "en"), ("", "de"), (" \t .. ", "fr"), ("only", "it")] + [("copy of a copy of a copy", "en")] * 60
    got = rows_of(collocations.collocations(frame(spark, rows)))
    assert got == brute(rows, 30, 80, 2000)
    assert len(got) > 20 and {"und", "en", "de"} <= {g[0] for g in got}


def test_chunks_and_filters_of_any_size(monkeypatch):
    """Small chunks, pieces and filters give the sums of one large one; no phrase is lost or counted twice between them."""
    class Task:
        @staticmethod
        def get():
            return Task
        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(collocations, "TaskContext", Task)
    rows = [(t, lang or "und") for t, lang in made(2, 60)] + [("aa bb cc dd ee " * 300, "en"), ("w" * 5000 + " " + "v" * 3000, "en"), ("a b", "en"), ("c", "en")]
    batch = collocations.pa.RecordBatch.from_arrays([collocations.pa.array([x[i] for x in rows]) for i in (0, 1)], names=["text", "lang"])

    def counted(n):
        total = Counter()
        seen = set()
        for out in collocations._chunks(iter([batch, batch])):
            r = {k: v[0] for k, v in out.to_pydict().items()}
            assert r["chunk"] not in seen
            seen.add(r["chunk"])
            names = ["A", *r["words"]]
            ids = np.frombuffer(r["ids"], "<u2")
            assert Counter(dict(zip(r["words"], r["counts"]))) == Counter(names[i] for i in ids[r["before"] :] if i) + Counter({w: 0 for w in r["words"]})
            if n == 1:
                total.update({(r["lang"], (w,)): c for w, c in zip(r["words"], r["counts"])})
            else:
                table = collocations.pa.array([np.arange(len(names)).astype("<i4").tobytes()])
                coded = collocations.pa.RecordBatch.from_arrays([out["lang"], out["before"], out["ids"], table], names=["lang", "before", "ids", "table"])
                class Full:
                    value = np.full(1 << 10, 255, np.uint8)
                for found in collocations._sequences(n, 16, 2, Full)(iter([coded])):
                    for lang, shard, data in zip(*(found.column(i).to_pylist() for i in range(3))):
                        keys, counts = quotient.read(data, quotient.width(16, n), 2, shard)
                        ids = quotient.unpack(quotient.restore(keys, quotient.width(16, n)), 16, n)
                        for *g, c in zip(*ids, counts):
                            total[lang, tuple(names[i] for i in g)] += int(c)
        return +total

    want = {n: counted(n) for n in (1, 2, 3, 4)}
    assert want[4]["en", ("aa", "bb", "cc", "dd")] == 600
    for name, value in (("CHUNK_WORDS", 50), ("PIECE", 7), ("BYTES", 40), ("HELD", 30), ("CHUNK_DISTINCT", 20)):
        monkeypatch.setattr(collocations, name, value)
        assert {n: counted(n) for n in (1, 2, 3, 4)} == want, name


def test_empty_and_rare(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [("a b c", "en")])).collect() == []
    one = rows_of(collocations.collocations(frame(spark, [("a a", "en")] * 30)))
    assert one == [("en", 1, "a a", 30, 60, 60, 60, 500000)]


def test_ranks_end_with_the_phrase(spark):
    rows = [(f"é{i} é{i}, z{i} z{i}", "en") for i in range(12)] * 30
    got = rows_of(collocations.collocations(frame(spark, rows), top=20))
    assert got == brute(rows, 30, 80, 20) and len(got) == 20


@pytest.mark.parametrize(("id_bits", "n"), [(1, 2), (3, 4), (17, 2), (20, 3), (31, 4)])
def test_filters_lose_nothing(id_bits, n):
    rng = np.random.default_rng(id_bits)
    ids = [rng.zipf(1.3, 4000) % ((1 << id_bits) - 1) + 1 for _ in range(n)]
    bits = quotient.width(id_bits, n)
    packed = quotient.pack(ids, id_bits)
    keys = quotient.permute(packed, bits)
    assert all((a == b).all() for a, b in zip(quotient.restore(keys, bits), packed))
    want = Counter(zip(*(x.tolist() for x in ids)))
    for shard_bits in (0, min(2, bits)):
        filters = quotient.shards(*quotient.counted(keys, None, bits), bits, shard_bits)
        got = {}
        for shard, data in filters:
            merged, counts = quotient.merge([data, data, data], bits, shard_bits, shard)
            got |= {tuple(map(int, g)): int(c) for *g, c in zip(*quotient.unpack(quotient.restore(merged, bits), id_bits, n), counts)}
        assert got == {g: 3 * c for g, c in want.items()}


def test_order_of_keys_that_share_a_half():
    rng = np.random.default_rng(9)
    hi, lo = rng.integers(0, 5, 3000).astype(np.uint64), rng.integers(0, 50, 3000).astype(np.uint64)
    (a, b), c = quotient.counted((hi, lo), None, 40)
    want = Counter(zip(hi.tolist(), lo.tolist()))
    assert list(zip(a.tolist(), b.tolist())) == sorted(want) and c.tolist() == [want[k] for k in sorted(want)]
