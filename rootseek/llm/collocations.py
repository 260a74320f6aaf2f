"""Phrase collocations of every language, counted in quotient filters.

Method: a pass over the texts writes chunks: words as 16-bit numbers of the chunk's own
dictionary, with the dictionary beside them. The dictionaries' sums give the
frequent words and their ids. Then phrases are counted length by length. A task
packs the id sequences of its chunks, permutes them and keeps them as counting
quotient filters (see ``quotient``) by language and shard; a shard's sorted
filters are merged in one task, which undoes the permutation and keeps the
frequent phrases. Only sequences whose shorter parts may be frequent are packed: a
bit table of the frequent shorter phrases, which may say yes too often but never
no, decides. Scores, cuts and containment are equi joins of frequent phrases.

A phrase cannot be more frequent than its parts, so nothing is lost by that. The
dictionary is broadcast when it is small (counted), otherwise the chunks'
dictionaries are joined with it. The bit table grows with the number of frequent
phrases up to ``MOST_BITS``; beyond, more sequences are packed in vain, with the
same results.

Defined cases: a null or empty text has no words; a null language is ``und``; a
piece or text of any length is read whole, chunks overlap by the words a phrase
needs; repeated rows count as often; a language without words or candidates has
no row; ties end with the phrase, so ranks are unique; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootseek.llm import quotient
from rootseek.llm.common import arrow_rows, chain, durable, partition_offsets, per_partition
from rootseek.session import new_folder

UNKNOWN = "und"
LONGEST = 4
#: A break between pieces. Upper-case ASCII letters are gone before it is put in.
BREAK = b"A"
_TABLE = bytes(
    0x41 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)
)
#: Bytes split at once, words handled at once.
BYTES, PIECE = 1 << 20, 4096
#: Distinct words (16 bits), words and dictionary bytes of a chunk; words that a task holds in all its open chunks.
CHUNK_DISTINCT, CHUNK_WORDS, CHUNK_BYTES, OPEN_WORDS, OPEN_DISTINCT = 65_535, 1_000_000, 4_000_000, 4_000_000, 300_000
#: The dictionary is broadcast up to so many words and bytes.
SMALL_WORDS, SMALL_BYTES = 400_000, 16_000_000
#: Sequences that a task holds before it writes filters, and sequences of a shard.
HELD, SHARD = 2_000_000, 2_000_000
#: Bits of the table for each frequent phrase, and in all (32 MB).
SPARE, MOST_BITS = 16, 28


# ---- words ----


def words(text: str) -> Iterator[list[bytes]]:
    """The words of a whole text with breaks between its pieces, in lists of bounded size."""
    data = text.encode().translate(_TABLE)
    at = 0
    while at < len(data):
        end = at + BYTES
        if end < len(data):
            cut = max(data.rfind(b" ", at + 1, end), data.rfind(BREAK, at + 1, end))
            if cut < 0:
                after = [x for x in (data.find(b" ", end), data.find(BREAK, end)) if x >= 0]
                cut = min(after, default=len(data))
            end = cut
        yield data[at:end].replace(BREAK, b" A ").split()
        at = end


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Chunk:
    """One language's words of a task, as numbers of an own dictionary; 0 is a break."""

    def __init__(self, before: list[bytes]):
        self.numbers = _Numbers({BREAK: 0})
        self.parts: list[np.ndarray] = []
        self.size = self.bytes = 0
        self.before = len(before)
        self.add(before)

    def add(self, part: list[bytes]) -> None:
        known = len(self.numbers)
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, part), np.uint16, len(part)))
        self.size += len(part)
        if len(self.numbers) > known:
            self.bytes += sum(map(len, part))
        self.last = part[1 - LONGEST :] if len(part) >= LONGEST - 1 else (getattr(self, "last", []) + part)[1 - LONGEST :]

    def full(self, more: int) -> bool:
        return len(self.numbers) + more > CHUNK_DISTINCT or self.size + more > CHUNK_WORDS or self.bytes > CHUNK_BYTES


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, lang, before, ids, words, counts): ``before`` leading words belong to the chunk before."""
    open_: dict[str, _Chunk] = {}
    base, made = TaskContext.get().partitionId() << 33, 0

    def close(lang: str) -> pa.RecordBatch:
        nonlocal made
        chunk = open_.pop(lang)
        ids = np.concatenate(chunk.parts)
        counts = np.bincount(ids[chunk.before :], minlength=len(chunk.numbers))
        made += 1
        return arrow_rows({
            "chunk": ([base + made], pa.int64()), "lang": ([lang], pa.string()), "before": ([chunk.before], pa.int32()), "ids": ([ids.astype("<u2").tobytes()], pa.binary()),
            "words": (pa.array([list(chunk.numbers)[1:]], pa.list_(pa.binary())).cast(pa.list_(pa.string())), None), "counts": ([counts[1:].tolist()], pa.list_(pa.int64())),
        })

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            for found in words(text):
                for at in range(0, len(found), PIECE):
                    part = found[at : at + PIECE]
                    chunk = open_.get(lang)
                    if chunk is not None and chunk.full(len(part)):
                        before = chunk.last
                        yield close(lang)
                        chunk = None
                        open_[lang] = _Chunk(before)
                    if lang not in open_:
                        open_[lang] = _Chunk([])
                    open_[lang].add(part)
            open_.setdefault(lang, _Chunk([])).add([BREAK])
            if sum(c.size for c in open_.values()) > OPEN_WORDS or sum(len(c.numbers) for c in open_.values()) > OPEN_DISTINCT:
                for name in list(open_):
                    yield close(name)
    for name in list(open_):
        yield close(name)


CHUNKS = "chunk long, lang string, before int, ids binary, words array<string>, counts array<long>"


def _kept(least: int):
    """The frequent words with a number within the partition, and every language's words in the partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, totals = TaskContext.get().partitionId(), 0, defaultdict(int)
        for batch in batches:
            for lang, amount in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                totals[lang] += amount
            batch = batch.filter(pa.compute.greater_equal(batch.column(2), least))
            yield arrow_rows({
                "lang": (batch.column(0), None), "word": (batch.column(1), None), "n": (batch.column(2), None),
                "part": (np.full(len(batch), part), pa.int32()), "at": (np.arange(n, n + len(batch)), pa.int64()),
            })
            n += len(batch)
        for lang, amount in totals.items():
            yield arrow_rows({"lang": ([lang], pa.string()), "word": ([None], pa.string()), "n": ([amount], pa.int64()), "part": ([part], pa.int32()), "at": ([None], pa.int64())})

    return work


def _written(chunks: DataFrame, label: str) -> DataFrame:
    """As ``durable``, in row groups of few rows: a chunk is large, and readers take many rows of a group at once."""
    path = new_folder(chunks.sparkSession, label)
    chunks.write.option("parquet.block.row.count.limit", "16").option("parquet.block.size", str(16 << 20)).parquet(path)
    return chunks.sparkSession.read.schema(chunks.schema).parquet(path)


# ---- id sequences ----


class Dictionary:
    """Ids of frequent words by language, in a form to broadcast."""

    def __init__(self, rows: pa.Table):
        self.rows = rows

    def lookup(self, lang: str) -> dict[str, int]:
        if not hasattr(self, "_ids"):
            self._ids: dict[str, dict[str, int]] = defaultdict(dict)
            for name, word, i in zip(*(self.rows[c].to_pylist() for c in ("lang", "word", "id"))):
                self._ids[name][word] = i
        return self._ids[lang]

    def __getstate__(self):
        return {"rows": self.rows}


def _numbered(known):
    """Chunks with the table of their ids, by the broadcast dictionary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = []
            for lang, names in zip(batch.column(1).to_pylist(), batch.column(3)):
                get = known.value.lookup(lang).get
                tables.append(np.array([0, *[get(w, 0) for w in names.as_py()]], "<i4").tobytes())
            yield arrow_rows({"lang": (batch.column(1), None), "before": (batch.column(0), None), "ids": (batch.column(2), None), "table": (tables, pa.binary())})

    return work


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the table of their ids, from the joined (at, id) of their frequent words."""
    for batch in batches:
        tables = []
        for size, found in zip(batch.column(3).to_pylist(), batch.column(4)):
            table = np.zeros(size + 1, "<i4")
            if found.is_valid:
                pairs = found.values.flatten()
                table[pairs[0].to_numpy() + 1] = pairs[1].to_numpy()
            tables.append(table.tobytes())
        yield arrow_rows({"lang": (batch.column(1), None), "before": (batch.column(0), None), "ids": (batch.column(2), None), "table": (tables, pa.binary())})


CODED = "lang string, before int, ids binary, table binary"


def _coded(chunks: DataFrame, frequent: DataFrame) -> tuple[DataFrame, Callable | None]:
    """(lang, before, ids, table): every chunk with the id of each of its words, 0 for breaks and rare words.

    Given as rows and the step that still makes them so, if any: it runs in the
    worker that goes on with them.
    """
    size = frequent.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("b")).first()
    if size.n <= SMALL_WORDS and size.b <= SMALL_BYTES:
        known = chunks.sparkSession.sparkContext.broadcast(Dictionary(frequent.select("lang", "word", "id").toArrow()))
        return chunks.select("before", "lang", "ids", "words"), _numbered(known)
    entries = chunks.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    found = entries.join(frequent.select("lang", "word", "id"), ["lang", "word"])
    tables = found.groupBy("chunk").agg(F.collect_list(F.struct("at", F.col("id").cast("int").alias("id"))).alias("found"))  # at most CHUNK_DISTINCT
    rows = chunks.select("chunk", "before", "lang", "ids", F.size("words").alias("size")).join(tables, "chunk", "left")
    return _written(per_partition(rows.select("before", "lang", "ids", "size", "found"), _joined, CODED), "coded-chunks"), None


def _sequences(n: int, id_bits: int, shard_bits: int, table):
    """Filters (lang, shard, filter) of all sequences of n ids whose parts of n - 1 ids are in the bit table."""
    bits, least_bits = quotient.width(id_bits, n), quotient.width(id_bits, n - 1)

    def windows(x: np.ndarray, before: int) -> list[np.ndarray]:
        good = x > 0
        if n == 2:
            fits = good[:-1] & good[1:]
        else:
            whole = good[: len(x) - n + 2].copy()
            for i in range(1, n - 1):
                whole &= good[i : len(x) - n + 2 + i]
            at = np.flatnonzero(whole)
            keys = quotient.permute(quotient.pack([x[at + i] for i in range(n - 1)], id_bits), least_bits)
            slots = quotient.mark(keys) & (len(table.value) * 8 - 1)
            part = np.zeros(len(whole), bool)
            part[at] = (table.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1
            fits = part[:-1] & part[1:]
        fits[: max(0, before - n + 1)] = False  # counted with the chunk before
        at = np.flatnonzero(fits)
        return [x[at + i] for i in range(n)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[quotient.Keys]] = defaultdict(list)
        total = 0

        def settle() -> Iterator[pa.RecordBatch]:
            for lang, keys in held.items():
                sums = quotient.counted(tuple(np.concatenate(k) for k in zip(*keys)), None, bits)
                filters = quotient.shards(*sums, bits, shard_bits)
                yield arrow_rows({"lang": (pa.array([lang] * len(filters), pa.string()), None), "shard": ([s for s, _ in filters], pa.int32()), "filter": ([f for _, f in filters], pa.binary())})
            held.clear()

        for batch in batches:
            for lang, before, ids, ids_of in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x = np.frombuffer(ids_of, "<i4")[np.frombuffer(ids, "<u2")]
                if len(x) < n:
                    continue
                found = windows(x, before)
                held[lang].append(quotient.permute(quotient.pack(found, id_bits), bits))
                total += len(found[0])
                if total >= HELD:
                    yield from settle()
                    total = 0
        yield from settle()

    return work


def _merge(n: int, id_bits: int, shard_bits: int, least: int):
    """Frequent sequences of a shard from all its filters."""
    bits = quotient.width(id_bits, n)

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, counts = quotient.merge([f.as_buffer().to_pybytes() for f in table["filter"]], bits, shard_bits, key[1].as_py())
        often = counts >= least
        keys = (keys[0][often], keys[1][often])
        ids = np.stack(quotient.unpack(quotient.restore(keys, bits), id_bits, n), axis=1).astype(np.int32)
        return pa.table({
            "lang": pa.array([key[0].as_py()] * len(ids), pa.string()), "ids": pa.FixedSizeListArray.from_arrays(pa.array(ids.ravel()), n).cast(pa.list_(pa.int32())),
            "a": pa.array(counts[often]), "mark": pa.array(quotient.mark(keys)),
        })

    return work


def _bit_table(frequent: DataFrame) -> np.ndarray:
    """A bit for each frequent sequence, by its mark."""
    rows = frequent.count()
    size = min(MOST_BITS, max(10, math.ceil(math.log2(max(1, SPARE * rows)))))
    slot = F.col("mark").bitwiseAND(F.lit((1 << size) - 1))
    words = frequent.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, int(mark & 63))").alias("bits"))
    found = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2 ** (MOST_BITS - 6) rows
    table = np.zeros(1 << (size - 6), "<i8")
    table[found["at"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint8)


# ---- phrases ----


def _key(ids: Column) -> Column:
    return F.concat_ws(" ", ids.cast("array<string>"))


class Counts:
    """Words of every language, frequent words with ids, and frequent phrases of two words and more."""

    def __init__(self, totals: DataFrame, words: DataFrame, phrases: DataFrame):
        self.totals, self.words, self.phrases = totals, words, phrases


def frequent_phrases(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST) -> Counts:
    """Exact counts of all phrases of up to ``longest`` words that occur ``least`` times in a language."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    chunks = _written(per_partition(rows, _chunks, CHUNKS), "chunks")
    each = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("lang", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    sums = each.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = durable(per_partition(sums, _kept(least), "lang string, word string, n long, part int, at long"), "words")
    totals = found.where("word IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    some = found.where("word IS NOT NULL")
    offsets = partition_offsets(some.groupBy("part").agg(F.count("*").alias("n")), "part", "n")
    frequent = durable(some.join(offsets, "part").select("lang", "word", "n", (F.col("before") + F.col("at") + 1).alias("id")), "frequent-words")
    most = frequent.agg(F.max("id").alias("id"), F.sum("n").alias("n")).first()
    id_bits = max(1, int(most.id or 0).bit_length())
    if id_bits > 31:
        raise ValueError("more than two thousand million frequent words; raise the least count")
    coded, first = _coded(chunks, frequent)
    levels, table = [], None
    for n in range(2, longest + 1):
        bits = quotient.width(id_bits, n)
        shard_bits = min(bits, 30, math.ceil(math.log2(max(1, (most.n or 0) / SHARD))))
        steps = [s for s in (first, _sequences(n, id_bits, shard_bits, table)) if s is not None]
        filters = per_partition(coded, chain(*steps), "lang string, shard int, filter binary")
        merged = filters.groupBy("lang", "shard").applyInArrow(_merge(n, id_bits, shard_bits, least), "lang string, ids array<int>, a long, mark long")
        levels.append(durable(merged, f"phrases-{n}"))
        if n < longest:
            table = docs.sparkSession.sparkContext.broadcast(_bit_table(levels[-1]))
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionAll(level)
    return Counts(totals, frequent, phrases.select("lang", "ids", _key(F.col("ids")).alias("key"), "a"))


def _scored(c: Counts) -> DataFrame:
    """(lang, key, ids, a, l, r, score): every phrase with its lowest-scoring cut, at the smallest place."""
    known = c.phrases.select("lang", "key", "a").unionAll(c.words.select("lang", F.col("id").cast("string").alias("key"), F.col("n").alias("a")))
    cuts = c.phrases.select("lang", "ids", "key", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", _key(F.slice("ids", 1, F.col("k"))).alias("first"), _key(F.slice("ids", F.col("k") + 1, F.size("ids"))).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("key").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("key").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    # 27 and 21 digits: exact, where products of longs may overflow
    cuts = cuts.withColumn("score", F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"))
    lowest = cuts.groupBy("lang", "key").agg(F.min(F.struct("score", "k", "l", "r", "a", "ids")).alias("m"))
    return lowest.select("lang", "key", *[F.col(f"m.{x}").alias(x) for x in ("ids", "a", "l", "r", "score")])


def _not_inside(scored: DataFrame, phrases: DataFrame, cover: int) -> DataFrame:
    """Phrases that no longer one contains with at least ``cover`` percent of their count."""
    size = F.size("ids")
    starts = phrases.where(size > 2).select("lang", "ids", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("n"))
    inside = starts.select("lang", "ids", "a", "n", F.explode(F.sequence(F.lit(1), size - F.col("n") + 1)).alias("at"))
    inside = inside.select("lang", _key(F.slice("ids", F.col("at"), F.col("n"))).alias("key"), "a")
    most = inside.groupBy("lang", "key").agg(F.max("a").alias("longer"))
    exact = lambda x: F.col(x).cast("decimal(20,0)")
    kept = scored.join(most, ["lang", "key"], "left")
    return kept.where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * cover)).drop("longer")


def collocations(
    docs: DataFrame, least: int = 30, cover: int = 80, top: int = 2000, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    c = frequent_phrases(docs, least, text_col, lang_col, longest)
    scored = durable(_not_inside(_scored(c), c.phrases, cover), "scored-phrases")
    # ties at the last place stay until their words are known
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = scored.withColumn("place", F.rank().over(place)).where(F.col("place") <= top)
    spelt = best.select("*", F.posexplode("ids").alias("at", "id")).join(c.words.select("id", "word"), "id")
    spelt = spelt.groupBy("lang", "key", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))  # at most LONGEST
    spelt = spelt.withColumn("phrase", F.concat_ws(" ", F.col("words.word")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(c.totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
