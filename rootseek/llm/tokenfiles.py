"""Token-id files: canonical length-limited Huffman codes, independent blocks, checkpoints.

Method: every task counts its ids, the counts are summed, and package-merge
gives code lengths of at most ``MAX_BITS``. Codes are canonical, so the
code book is the array of lengths. A file row is one block of whole documents:
the concatenated codes, and the bit offset of every ``STRIDE``-th token, so
that a reader decodes all stretches of a block side by side through one table
that is indexed by the next ``MAX_BITS`` bits.

Files (Parquet as the container, sorted by document id across parts):

* ``book``: symbol, bits
* ``blocks``: part, block, before (tokens of the part before the block),
  doc_ids, n_tokens, marks (bit offsets), payload

Defined cases: a null or empty text holds the end id alone; equal ids stay
separate documents; an empty table gives no blocks and an empty result; columns
other than the two named ones are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootseek.llm import tokens
from rootseek.llm.common import arrow_rows, ceil_div, durable, partition_offsets, per_partition

#: Longest code. The decoding table has 2**MAX_BITS entries of 4 bytes.
MAX_BITS = 18
#: Tokens between two checkpoints of a block.
STRIDE = 64
#: A block closes when it has so many tokens.
BLOCK_TOKENS = 1 << 18
#: Ids per partition of the sorted table, about 64 MB before coding.
PART_TOKENS = 1 << 24


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    n = len(order)
    rows, packages = [], np.zeros(0)
    for _ in range(limit):  # each row: is entry i of the merged list a leaf?
        weights = np.concatenate([leaves, packages])
        at = np.argsort(weights, kind="stable")
        rows.append(at < n)
        merged = weights[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(rows):
        chosen = leaf[:take]
        k = int(chosen.sum())
        lengths[:k] += 1
        take = 2 * (len(chosen) - k)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order].astype(np.uint64)
    top = np.uint64(MAX_BITS)
    steps = np.uint64(1) << (top - size)
    starts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(steps, dtype=np.uint64)[:-1]])
    codes[order] = starts >> (top - size)
    return codes


def decoding_table(lengths: np.ndarray) -> np.ndarray:
    """Entry for each string of ``MAX_BITS`` bits: symbol * 32 + code length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order].astype(np.int64)
    table = np.zeros(1 << MAX_BITS, np.uint32)
    filled = np.repeat((order * 32 + size).astype(np.uint32), 1 << (MAX_BITS - size))
    table[: len(filled)] = filled
    return table


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, marks): the codes as one string of bits, and where each stretch begins."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    start = end - size
    words = np.zeros(ceil_div(total, 32) + 2, np.uint64)
    if len(ids):
        word = start >> 5
        shifted = codes[ids] << (64 - (start & 31) - size).astype(np.uint64)  # a code spans two 32-bit words at most
        first = np.flatnonzero(np.diff(word, prepend=-1))
        both = np.add.reduceat(shifted, first)  # bits of different codes never meet
        words[word[first]] += both >> np.uint64(32)
        words[word[first] + 1] += both & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: ceil_div(total, 8)], start[::STRIDE].astype("<i8").tobytes()


def unpack(payload: bytes, marks: bytes, n: int, table: np.ndarray) -> np.ndarray:
    """The ``n`` ids of a block; all stretches between checkpoints advance together."""
    data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    ahead = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]  # the 32 bits from each byte on
    at = np.frombuffer(marks, "<i8").copy()
    out = np.zeros((STRIDE, len(at)), np.uint32)
    full, drop = n - STRIDE * (len(at) - 1) if len(at) else 0, np.uint32(32 - MAX_BITS)
    for step in range(STRIDE):
        if step == full:
            at = at[:-1]  # the last stretch is short
        hit = table[(ahead[at >> 3] << (at & 7).astype(np.uint32)) >> drop]
        out[step, : len(at)] = hit >> 5
        at = at + (hit & 31)
    return out.T.ravel()[:n]


def encode_ids(texts: DataFrame, path: str, id_col: str, text_col: str, end_id: int | None) -> DataFrame:
    """(id, ids binary): the ids of every whole text, written once. 2 or 4 bytes an id."""
    narrow = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x + tail for x in tokens.id_lists(path, batch.column(1).to_pylist())]
            yield arrow_rows({"id": (batch.column(0), None), "n": ([len(x) // 4 for x in lists], pa.int64()), "ids": ([_narrow(x) for x in lists], pa.binary())})

    return per_partition(narrow, work, "id long, n long, ids binary")


def _narrow(ids: bytes) -> bytes:
    """A leading 0 and 16-bit ids where all fit, else a leading 1 and 32-bit ids."""
    x = np.frombuffer(ids, "<u4")
    return b"\0" + x.astype("<u2").tobytes() if not len(x) or x.max() < 65536 else b"\1" + ids


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[:1] == b"\0" else "<u4", offset=1).astype(np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        lists = [_wide(x) for x in batch.column(0).to_pylist()]
        found = np.bincount(np.concatenate(lists)) if lists else total
        size = max(len(found), len(total))
        total = np.pad(total, (0, size - len(total))) + np.pad(found, (0, size - len(found)))
    used = np.flatnonzero(total)
    yield arrow_rows({"symbol": (used, pa.int64()), "n": (total[used], pa.int64())})


def write_files(texts: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> None:
    """Encode all texts and write ``folder/book`` and ``folder/blocks`` in ascending id order."""
    spark = texts.sparkSession
    lists = durable(encode_ids(texts, path, id_col, text_col, end_id), "ids")
    counts = per_partition(lists.select("ids"), _count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(1 + max([r.symbol for r in counts], default=0), np.int64)
    for r in counts:  # one row per vocabulary entry
        table[r.symbol] = r.n
    lengths = code_lengths(table)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in used], "symbol long, bits int").coalesce(1).write.parquet(f"{folder}/book")
    parts = max(1, ceil_div(int(table.sum()), PART_TOKENS), spark.sparkContext.defaultParallelism)
    sent = spark.sparkContext.broadcast((codes, lengths))
    ordered = lists.repartitionByRange(parts, "id").sortWithinPartitions("id", "ids")
    blocks = per_partition(ordered, _to_blocks(sent), BLOCKS)
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


BLOCKS = "part int, block int, before long, tokens long, doc_ids array<long>, n_tokens array<long>, marks binary, payload binary"


def _to_blocks(book):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = book.value
        part, block, before = TaskContext.get().partitionId(), 0, 0
        names, lists, held = [], [], 0

        def close():
            payload, marks = pack(np.concatenate(lists), codes, lengths)
            return arrow_rows({
                "part": ([part], pa.int32()), "block": ([block], pa.int32()), "before": ([before], pa.int64()), "tokens": ([held], pa.int64()),
                "doc_ids": ([names], pa.list_(pa.int64())), "n_tokens": ([[len(x) for x in lists]], pa.list_(pa.int64())),
                "marks": ([marks], pa.binary()), "payload": ([payload], pa.binary()),
            })

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                names.append(name)
                lists.append(_wide(ids.as_py()))
                held += len(lists[-1])
                if held >= BLOCK_TOKENS:
                    yield close()
                    block, before, names, lists, held = block + 1, before + held, [], [], 0
        if names:
            yield close()

    return work


def read_files(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray]:
    """The blocks of a written folder and its code lengths."""
    book = spark.read.parquet(f"{folder}/book").collect()
    lengths = np.zeros(1 + max([r.symbol for r in book], default=0), np.uint8)
    for r in book:
        lengths[r.symbol] = r.bits
    return spark.read.parquet(f"{folder}/blocks"), lengths


def decode_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, read back from the files."""
    blocks, lengths = read_files(spark, folder)
    totals = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    sent = spark.sparkContext.broadcast(lengths)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["marks"], row["tokens"], table)
                ends = np.cumsum(row["n_tokens"])
                starts = ends - row["n_tokens"]
                own = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                out = {
                    "part": ([row["part"]] * len(own), pa.int32()), "doc_id": (row["doc_ids"], pa.int64()), "start": (starts + row["before"], pa.int64()),
                    "n_tokens": (row["n_tokens"], pa.int64()), "ids_crc32": ([zlib.crc32(x) for x in own], pa.int64()),
                }
                if with_ids:
                    out["ids"] = ([np.frombuffer(x, "<u4").astype(np.int32) for x in own], pa.list_(pa.int32()))
                yield arrow_rows(out)

    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    decoded = per_partition(blocks.drop("block"), work, schema)
    placed = decoded.join(partition_offsets(totals, "part", "tokens"), "part")
    return placed.withColumn("start", F.col("start") + F.col("before")).drop("part", "before")
