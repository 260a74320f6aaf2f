"""Token ids, counts, files and batches against the libraries and brute force."""

import itertools
import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brute import CLASHING, documents, frame
from rootseek.llm import common, packing, sentencepieces, tokencount, tokenfiles, tokens
from rootseek.llm.jaccard import text_key
from rootseek.session import new_folder

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "İ, x", "क़, y.", "a\x1c\x1cb !\x1c!", "foo<|endoftext|>bar <|endoftext|>", "don't we'll 12.5 x² ﬁ Å ½ é, 　x\xa0y", "", "   ", "ΑΣ, ΑΣ.", "'s,t", "…., .,",
    "it's. 'tis", "́abc", "a ,b", "한국어. ㄱㅏ,", "\x85a\x85,", "a" * 5000 + ".", "🙂🙂 🏳️‍🌈 漢字かな", "  hello   World\n\ttab  ", "<0x0A><s></s><unk>", " " * 200,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def test_chunk_ids_equal_the_library(library):
    texts = [*HARD, None, *[t for _, t in documents()]]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.id_lists(WORDS, texts)] == want


def test_stems_and_marks_equal_the_library_and_few_chunks_go_whole(library, monkeypatch):
    letters = [*map(chr, range(0x41, 0x250)), "e\u0301", "A\u030a", "ΑΣ", "ß", "ǅa", "жЖ", "漢", "ﬁ", "क़", "ab", "ſ"]
    tails = [*string.punctuation, "...", "'s", "'S.", "'.", "$$$", "<|endoftext|>", "<", "|>", "\u0338", "…", "_a", "--b"]
    texts = [" ".join(a + b + t for a in letters for b in ("", "Q")) for t in tails] + ["''s ' 's &&& <|endoftext|>, x<|endoftext|>"]
    got = tokens.ChunkEncoder(WORDS).encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    sent, whole = [], tokens.ChunkEncoder._whole
    monkeypatch.setattr(tokens.ChunkEncoder, "_whole", lambda self, items: sent.extend(items) or whole(self, items))
    tokens.ChunkEncoder(WORDS).encode_all([" ".join(f"W{a}{b}{t}" for a in "abcdé" for b in "xyz" for t in ("", "&&&", "!!", ")."))])
    assert len(sent) <= 4  # marks alone, not each word with its marks


def test_small_caches_change_nothing(monkeypatch, library):
    for name, size in (("CACHE_WORDS", 50), ("PIECE", 7), ("LEARNED", 3)):
        monkeypatch.setattr(tokens, name, size)
    texts = [*HARD, *[t for _, t in documents(n=60)][:60]]
    got = tokens.ChunkEncoder(WORDS).encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path, rows = public_tokenizers.path(name), [*documents(n=40), *enumerate(HARD, 20_000), (None, "x y")]
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        whole = Tokenizer.from_file(path)
        count = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    got = tokencount.token_counts(frame(spark, rows), path, frequent=20).collect()
    want = [(i, len((t or "").encode()), count(t or "")) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokencount.token_counts(spark.createDataFrame([], CLASHING), path).count() == 0


def test_workers_give_up_words_that_later_work_does_not_use():
    def encode(batches):
        for batch in batches:
            tokens.id_lists(WORDS, batch.column(0).to_pylist())
            yield batch

    def run(work, rows):
        return list(common._tidy(work)(iter([pa.RecordBatch.from_pydict({"text": pa.array(rows, pa.string())})])))

    run(encode, ["some words", None])
    mine = tokens.encoder(WORDS)
    run(encode, ["other words"])
    assert tokens.encoder(WORDS) is mine and {"some", "other"} <= mine.known.keys()
    run(lambda batches: batches, [])
    assert tokens.encoder(WORDS) is mine  # a task without rows tells nothing
    run(lambda batches: batches, ["rows of another operator"])
    assert tokens.encoder(WORDS) is not mine


def test_token_files_round_trip(spark, library, monkeypatch):
    rows = [*documents(n=60), *enumerate(HARD, 20_000)]
    folder = new_folder(spark, "tokens")
    tokenfiles.write_files(frame(spark, rows), WORDS, folder, end_id=2)
    got = tokenfiles.decode_files(spark, folder).orderBy("doc_id", "start").collect()
    want = sorted([(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows], key=lambda r: r[0])
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert sorted((r.doc_id, r.ids) for r in got) == sorted(want)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)
    parts = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.min(F.array_min("doc_ids")).alias("lo"), F.max(F.array_max("doc_ids")).alias("hi")).orderBy("part").collect()
    assert all(a.hi <= b.lo for a, b in itertools.pairwise(parts))


def test_no_documents_give_empty_files(spark):
    folder = new_folder(spark, "tokens")
    tokenfiles.write_files(spark.createDataFrame([], CLASHING), WORDS, folder)
    assert tokenfiles.decode_files(spark, folder).count() == 0


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    for counts in (np.array([5]), np.array([0, 1, 0, 1]), np.array(fib), rng.zipf(1.3, 20_000) % 10_000):
        lengths = tokenfiles.code_lengths(counts)
        used = lengths[lengths > 0].astype(float)
        assert used.max() <= tokenfiles.MAX_BITS and (len(used) == 1 or (2.0**-used).sum() == 1)
        assert ((lengths > 0) == (counts > 0)).all()
        codes, table = tokenfiles.canonical(lengths), tokenfiles.decoding_table(lengths)
        for n in (1, 63, 64, 65, 128, 5000):
            ids = rng.choice(np.flatnonzero(counts), n).astype(np.uint32)
            payload, marks = tokenfiles.pack(ids, codes, lengths)
            assert (tokenfiles.unpack(payload, marks, n, table) == ids).all()
    small = np.array([1, 2, 4, 9, 20, 41])
    kraft = [c for c in itertools.product(range(1, 5), repeat=6) if sum(2.0**-x for x in c) <= 1]
    assert (tokenfiles.code_lengths(small, 4) * small).sum() == min((np.array(c) * small).sum() for c in kraft)


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= size) - size) for size, n in zip(lengths, counts))


def test_bucket_bounds_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(40):
        m = int(rng.integers(1, 9))
        lengths, counts = np.sort(rng.choice(50, m, replace=False)) + 1, rng.integers(1, 100, m)
        for k in (1, 2, 3, 10):
            got = packing.bucket_bounds(lengths, counts, k)
            every = [[*c, lengths[-1]] for r in range(min(k, m)) for c in itertools.combinations(lengths[:-1].tolist(), r)]
            assert len(got) <= k and padding(lengths, counts, got) == min(padding(lengths, counts, b) for b in every)
    assert packing.bucket_bounds(np.zeros(0, int), np.zeros(0, int), 4) == []


def test_batches_hold_every_token_once(spark, library):
    rows = [*documents(n=80), (70_000, None)]
    got = packing.pack(frame(spark, rows), WORDS, max_len=64, buckets=4, budget=256).collect()
    sizes = sorted((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    whole = {}
    for i, n in sizes:
        whole[i] = whole.get(i, 0) + n
    for i, n in whole.items():
        assert sum(r.length for r in got if r.doc_id == i) == n
    assert all(0 <= r.length <= 64 and r.start == r.seq * 64 for r in got)
    assert all((r.bound is None) == (r.length == 0) and (r.length == 0 or r.length <= r.bound) for r in got)
    seats = [(r.bound, r.batch, r.slot) for r in got if r.length]
    assert len(set(seats)) == len(seats)
    for bound in {b for b, _, _ in seats}:
        full, mine = 256 // bound, sorted(s[1:] for s in seats if s[0] == bound)
        assert mine == [divmod(k, full) for k in range(len(mine))]
    assert packing.pack(spark.createDataFrame([], CLASHING), WORDS).count() == 0


def test_written_batches_give_every_text_back(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "PART_TOKENS", 3_000)
    monkeypatch.setattr(packing, "PART_ROWS", 50)
    rows = [*documents(n=80), (70_000, None), (5, "one text"), (5, "one text"), (None, "of no id"), (None, "of no id"), (None, "of no id as well")]
    folder = new_folder(spark, "batches")
    got = packing.write_batches(frame(spark, rows), WORDS, folder, max_len=64, buckets=4, budget=256).collect()
    found = {}
    for r in got:
        assert r.rows == len(r.doc_ids) == len(r.lengths) == len(r.starts) == len(r.text_keys) and len(r.ids) == r.rows * r.bound
        assert 0 < r.rows * r.bound <= max(256, r.bound)
        for slot in range(r.rows):
            own = r.ids[slot * r.bound : (slot + 1) * r.bound]
            assert not any(own[r.lengths[slot] :])
            found.setdefault((r.doc_ids[slot], r.text_keys[slot]), []).append((r.starts[slot], own[: r.lengths[slot]]))
    wanted = {}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        for start in range(0, len(ids), 64):
            wanted.setdefault((i, text_key(text)), []).append((start, ids[start : start + 64]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}
    for bound in {r.bound for r in got}:
        sizes = [n for _, n in sorted((r.batch, r.rows) for r in got if r.bound == bound)]
        assert sorted(r.batch for r in got if r.bound == bound) == list(range(len(sizes)))
        assert all(n == 256 // bound for n in sizes[:-1])
    assert packing.write_batches(spark.createDataFrame([], CLASHING), WORDS, new_folder(spark, "batches")).count() == 0


def test_written_batches_lie_where_pack_says(spark):
    rows = [(i, t) for i, t in documents(n=60) if i < 9000][:60]
    places = {(r.bound, r.batch, r.slot): (r.doc_id, r.start, r.length) for r in packing.pack(frame(spark, rows), WORDS, max_len=64, buckets=4, budget=256).collect() if r.length}
    got = packing.write_batches(frame(spark, rows), WORDS, new_folder(spark, "batches"), max_len=64, buckets=4, budget=256).collect()
    assert {(r.bound, r.batch, s): (r.doc_ids[s], r.starts[s], r.lengths[s]) for r in got for s in range(r.rows)} == places


def test_pieces_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [*documents(n=60), *enumerate(HARD, 20_000)]
    got = sentencepieces.round_trip(frame(spark, rows), PIECES)
    found = sorted((r.doc_id, r.ids) for r in got.collect())
    assert found == sorted((i, model.encode(t or "")) for i, t in rows)
    assert all(r.same and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got.collect())
    texts = sorted((r.doc_id, r.text) for r in sentencepieces.decode(got, PIECES).collect())
    assert texts == sorted((i, model.decode(ids)) for i, ids in found)
    assert sentencepieces.encode(spark.createDataFrame([], CLASHING), PIECES).count() == 0
