"""Token counts of whole texts: a broadcast table of frequent chunks, worker caches for the rest.

Method: map-side lookup in two tiers. A first pass lets every task count its
white-space separated chunks in bounded memory and hand over its most frequent
ones; the sums' top entries are encoded once and broadcast with their lengths.
The second pass adds up lengths from that table; chunks it lacks go to the
worker's own cache of library results. No chunk of a text is ever shuffled: the
only exchange holds the tasks' short lists.

Defined cases: a null or empty text has 0 bytes and 0 tokens; duplicate ids
stay separate rows; an empty table gives an empty result; columns other than
the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootseek.llm import tokens
from rootseek.llm.common import arrow_rows, per_partition

#: Entries of the broadcast table: at most about 1 MB.
FREQUENT = 65_536
#: Chunks a task keeps while counting; the rarest go when there are more.
KEPT = 400_000
#: Longest chunk in the table, in characters.
LONGEST = 64


def _task_heads(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(tokens.chunks(text))
                if len(seen) > 2 * KEPT:
                    seen = Counter(dict(seen.most_common(KEPT)))
        head = [(c, n) for c, n in seen.most_common(size) if len(c) <= LONGEST]
        yield arrow_rows({"chunk": ([c for c, _ in head], pa.string()), "n": ([n for _, n in head], pa.int64())})

    return work


def frequent_chunks(texts: DataFrame, text_col: str = "text", size: int = FREQUENT) -> list[str]:
    """About the ``size`` most frequent chunks of all texts; the exact choice only affects speed."""
    heads = per_partition(texts.select(F.col(text_col)), _task_heads(size), "chunk string, n long")
    top = heads.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(size)
    return [r.chunk for r in top.select("chunk").collect()]


class Table:
    """Chunk lengths in compact form: one string, one array. Unpacked once per worker."""

    def __init__(self, chunks: list[str], lengths: list[int]):
        self.text, self.lengths = "\n".join(chunks), np.array(lengths, np.uint16).tobytes()

    def unpack(self) -> dict[str, int]:
        if not hasattr(self, "_table"):
            names = self.text.split("\n") if self.text else []
            self._table = dict(zip(names, np.frombuffer(self.lengths, np.uint16).tolist()))
        return self._table

    def __getstate__(self):
        return {"text": self.text, "lengths": self.lengths}


def _add_up(path: str, table: dict[str, int], text: str | None) -> int:
    if not text:
        return 0
    encoder = tokens.encoder(path)
    parts, total = tokens.chunks(text), 0
    for at in range(0, len(parts), tokens.PIECE):
        piece = parts[at : at + tokens.PIECE]
        found = list(map(table.get, piece))
        misses = [c for c, n in zip(piece, found) if n is None]
        total += sum(filter(None, found)) + sum(map(len, encoder.lookup(misses))) // 4
    return total


def token_counts(
    texts: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row. ``path`` names the vocabulary file.

    A ``.model`` file or a vocabulary that keeps white space has no chunk
    tables: its texts go whole to the library, still map-side.
    """
    narrow = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_bytes long, n_tokens long"
    chunked = path.endswith(".json") and tokens.drops_white_space(path)
    table = None
    if chunked:
        head = [c for c in frequent_chunks(narrow, "text", frequent) if "\n" not in c]
        lengths = [len(x) // 4 for x in tokens.ChunkEncoder(path).lookup(head)] if head else []
        table = narrow.sparkSession.sparkContext.broadcast(Table(head, lengths))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value.unpack() if chunked else None
        for batch in batches:
            values = batch.column(1).to_pylist()
            counts = [_add_up(path, known, t) for t in values] if chunked else [len(x) // 4 for x in tokens.id_lists(path, values)]
            sizes = [len(t.encode()) if t else 0 for t in values]
            yield arrow_rows({"id": (batch.column(0), None), "n_bytes": (sizes, pa.int64()), "n_tokens": (counts, pa.int64())})

    return per_partition(narrow, work, schema).withColumnRenamed("id", id_col)
