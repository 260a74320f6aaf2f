"""Training batches from optimal length buckets.

Method: texts become sequences of at most ``max_len`` tokens (longer texts are cut
into several, none is dropped). The global histogram of lengths has at most
``max_len`` rows, so dynamic programming over it finds the bucket bounds that
minimise padding exactly. Inside a bucket, sequences in order of document and
position fill batches of ``budget // bound`` rows, each padded to the bound.
Positions in a bucket come from running counts per partition plus the counts
of the partitions before, so one bucket may hold nearly all rows.

``pack`` gives the places alone, from token counts. ``write_batches`` encodes each
text once, lets its ids travel with its sequences through the same placing, and
writes them by bound and batch; the places are the same for documents of different
id or length.

Defined cases: a null or empty text, which has no tokens, keeps one row with
length 0 and no bucket, and has no row in written batches; equal ids stay separate
documents, numbered by their lengths and, in written batches, by a key of the text;
rows that agree in id and text are written as often as they come; a very long text
is cut into as many sequences as it needs; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootseek.llm import tokencount, tokens
from rootseek.llm.common import arrow_rows, ceil_div, durable, per_partition
from rootseek.llm.jaccard import text_key

#: Longest sequence, number of buckets, tokens of a batch with padding.
MAX_LEN, BUCKETS, BUDGET = 2048, 16, 65_536
#: Sequences per partition while they are numbered.
PART_ROWS = 1_000_000
#: Tokens per partition where ids are carried, about 64 MB.
PART_TOKENS = 1 << 24


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length ranges with the least padding in all.

    ``lengths`` ascend. Among equally good choices the one with fewer buckets,
    then with smaller bounds, wins.
    """
    m = len(lengths)
    if not m:
        return []
    size, total = lengths.astype(object), np.concatenate([[0], np.cumsum(counts.astype(object))])
    exact = np.int64 if int(total[-1]) * int(lengths[-1]) < 2**62 else object
    size, total = size.astype(exact), total.astype(exact)
    # padded[i, j]: tokens with padding when lengths i..j share the bound lengths[j]
    cost = total[1:] * size
    best, chosen = cost.copy(), []
    for _ in range(1, min(buckets, m)):
        # split[i, j]: the last bucket begins behind length i
        split = best[:, None] + cost[None, :] - total[1:, None] * size[None, :]
        split[np.tril_indices(m)] = cost[-1] if exact is object else np.iinfo(np.int64).max
        at = split.argmin(axis=0)
        value = split[at, np.arange(m)]
        better = value < best
        chosen.append(np.where(better, at, -1))
        best = np.where(better, value, best)
    bounds, j = [], m - 1
    for step in reversed(chosen):
        if step[j] >= 0:
            bounds.append(int(lengths[j]))
            j = int(step[j])
    return sorted([*bounds, int(lengths[j])])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running position of each sequence among those of its bucket in this partition."""
    part, seen = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        bucket = batch.column(batch.schema.get_field_index("bucket")).to_numpy(zero_copy_only=False)
        place = np.zeros(len(bucket), np.int64)
        for b in np.unique(bucket).tolist():
            mine = bucket == b
            place[mine] = seen[b] + np.arange(mine.sum())
            seen[b] += int(mine.sum())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(bucket), part), pa.int32()), pa.array(place)], names=[*batch.schema.names, "part", "place"]
        )


def pack_lengths(
    counts: DataFrame, id_col: str = "doc_id", n_col: str = "n_tokens", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """(id, seq, start, length, bound, batch, slot) of every sequence of documents with known token counts."""
    docs = durable(counts.select(F.col(id_col).alias("id"), F.coalesce(F.col(n_col).cast("long"), F.lit(0)).alias("n")), "lengths")
    pieces = F.greatest(F.ceil(F.col("n") / max_len), F.lit(1)).cast("int")
    seqs = docs.select("id", "n", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("seq")).withColumn("start", F.col("seq").cast("long") * max_len)
    seqs = seqs.withColumn("length", F.least(F.col("n") - F.col("start"), F.lit(max_len)).cast("int"))
    placed = _placed(seqs, ["id", "n", "seq"], max_len, buckets, budget)
    return placed.select(F.col("id").alias(id_col), "seq", "start", "length", "bound", "batch", "slot")


def _placed(seqs: DataFrame, order: list[str], max_len: int, buckets: int, budget: int) -> DataFrame:
    """``seqs`` with bound, batch and slot by their column length; inside a bucket they are numbered in the given order."""
    histogram = sorted((r.length, r.n) for r in seqs.groupBy("length").agg(F.count("*").alias("n")).collect())  # max_len + 1 rows at most
    rows = sum(n for _, n in histogram)
    lengths, amounts = (np.array([h[i] for h in histogram if h[0] > 0], np.int64) for i in (0, 1))
    bounds = bucket_bounds(lengths, amounts, buckets)
    bucket_of = np.searchsorted(bounds, np.arange(max_len + 1)).tolist() if bounds else [0] * (max_len + 1)
    bucket_of[0] = -1
    carried = sum(size * n for size, n in histogram) if "ids" in seqs.columns else 0
    parts = max(1, ceil_div(rows, PART_ROWS), ceil_div(carried, PART_TOKENS), seqs.sparkSession.sparkContext.defaultParallelism)
    names = seqs.columns
    table = F.array(*[F.lit(b) for b in bucket_of])
    sorted_seqs = seqs.withColumn("bucket", F.get(table, F.col("length"))).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_seqs.schema.fields) + ", part int, place long"
    numbered = durable(per_partition(sorted_seqs, _number, schema), "sequences")
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("bucket", "part").agg(F.count("*").alias("n_part")).select(
        "bucket", "part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("offset")
    )
    bound = F.get(F.array(*[F.lit(b) for b in bounds]), F.col("bucket")) if bounds else F.lit(None).cast("int")
    full = F.greatest(F.floor(F.lit(budget) / bound), F.lit(1))
    at = F.col("place") + F.col("offset")
    packed = numbered.join(offsets, ["bucket", "part"]).withColumn("bound", F.when(F.col("bucket") >= 0, bound))
    return packed.select(*names, "bound", F.when(F.col("bucket") >= 0, F.floor(at / full)).alias("batch"), F.when(F.col("bucket") >= 0, at % full).cast("long").alias("slot"))


def pack(texts: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``pack_lengths`` over the token counts of whole texts."""
    return pack_lengths(tokencount.token_counts(texts, path, id_col, text_col), id_col, "n_tokens", **options)


def sequences(texts: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """(id, n, tid, seq, start, length, ids binary) of every sequence; ``ids`` are little-endian unsigned 32-bit integers."""
    narrow = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            rows = []
            for name, text, ids in zip(batch.column(0).to_pylist(), values, tokens.id_lists(path, values)):
                n, tid = len(ids) // 4, text_key(text)
                for seq, start in enumerate(range(0, n, max_len)):
                    piece = ids[4 * start : 4 * (start + max_len)]
                    rows.append((name, n, tid, seq, start, len(piece) // 4, piece))
            columns = list(zip(*rows)) or [()] * len(_SEQUENCE)
            yield arrow_rows({name: (list(values), kind) for values, (name, kind) in zip(columns, _SEQUENCE)})

    return per_partition(narrow, work, "id long, n long, tid long, seq int, start long, length int, ids binary")


_SEQUENCE = (("id", pa.int64()), ("n", pa.int64()), ("tid", pa.int64()), ("seq", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()))


def _to_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted sequences as one row per batch, padded to its bound; a batch lies in one partition."""
    held: list[dict] = []

    def close() -> pa.RecordBatch:
        bound = held[0]["bound"]
        padded = b"".join(r["ids"].ljust(4 * bound, b"\0") for r in held)
        values = pa.array(np.frombuffer(padded, "<u4").astype(np.int64))
        return arrow_rows({
            "bound": ([bound], pa.int32()), "batch": ([held[0]["batch"]], pa.int64()), "rows": ([len(held)], pa.int32()),
            "doc_ids": ([[r["id"] for r in held]], pa.list_(pa.int64())), "text_keys": ([[r["tid"] for r in held]], pa.list_(pa.int64())),
            "starts": ([[r["start"] for r in held]], pa.list_(pa.int64())), "lengths": ([[r["length"] for r in held]], pa.list_(pa.int32())),
            "ids": (pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), None),
        })

    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["bound"], row["batch"]) != (held[0]["bound"], held[0]["batch"]):
                yield close()
                held.clear()
            held.append(row)
    if held:
        yield close()


def write_batches(
    texts: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """Write ``folder`` (Parquet, one row per batch, in folders by bound) and give it back as a table.

    Columns: bound, batch (from 0 within its bound), rows, and by slot doc_ids, text_keys,
    starts and lengths; ids holds ``rows`` times ``bound`` token ids, padded with 0 behind
    each length. Every id of every text is in exactly one batch.
    """
    seqs = durable(sequences(texts, path, id_col, text_col, max_len), "sequence-ids")
    placed = _placed(seqs, ["id", "n", "tid", "seq"], max_len, buckets, budget)
    spark = texts.sparkSession
    parts = max(1, ceil_div(seqs.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], PART_TOKENS), spark.sparkContext.defaultParallelism)
    ordered = placed.repartitionByRange(parts, "bound", "batch").sortWithinPartitions("bound", "batch", "slot")
    schema = "bound int, batch long, rows int, doc_ids array<long>, text_keys array<long>, starts array<long>, lengths array<int>, ids array<long>"
    per_partition(ordered.select("bound", "batch", "id", "tid", "start", "length", "ids"), _to_batches, schema).write.mode("overwrite").partitionBy("bound").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
