"""Removal of byte strings that occur again anywhere in the corpus, with suffix arrays.

Method: two-stage suffix sorting and adjacent common prefixes (``suffixes``),
run on blocks that together hold every string that can repeat. Blocks are cut
by content: of each window of ``width`` bytes, the ``GRAM``-byte gram with the
smallest hash is the anchor, so equal windows have equal anchors at equal
places. Consecutive windows with the same anchor form a segment, the
bytes they cover. Anchors whose gram occurs once cannot lie in a repeated window and are
dropped; all segments of one gram go to one block, where suffix sorting finds
the windows that occur again. Equal segments count as one string with a
multiplicity, as do equal texts.

A gram with very many different segments is cut again into pieces that only meet
pieces with the same common core, down to single windows if need be, so no
block grows with the corpus. Grams frequent within a task skip the
gathering by gram. Nothing is sampled or capped; the result is exact up to
collisions of 64-bit hashes.

Defined cases: a null or empty text has 0 bytes and nothing to remove; a text
shorter than the window stays whole; equal ids stay separate rows, each with
its own text; an empty table gives an empty result; columns other than the two
named ones are ignored, or kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootseek.llm import rolling, suffixes
from rootseek.llm.common import arrow_rows, ceil_div, chain, durable, per_partition
from rootseek.llm.jaccard import add_key, bit_filter, ddl, passing

#: Bytes of an anchor's gram.
GRAM = 50
#: Bytes handled at once; a longer text goes in overlapping pieces.
BYTES = 1 << 18
#: Anchors per bucket of the packed shuffle: about 12 MB, sorted in one worker.
BUCKET_ANCHORS = 500_000
#: Occurrences in one task from which a gram skips that shuffle.
FREQUENT = 16
#: Different segments from which a gram is cut into pieces, and windows of a piece at each further level.
MANY, STEPS = 1000, (8, 1)
#: Text of a block, in bytes.
BLOCK = 1 << 18
#: Segments a task remembers having sent.
SEEN = 200_000


# --- anchors ----------------------------------------------------------------
def _window_minimum(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours, by doubling."""
    span, out = 1, x
    while 2 * span <= size:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = size - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(gram hash, first window, windows, gram's place in the first window) of each segment of a stretch."""
    grams = width - GRAM + 1
    sums = rolling.prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    hashes = rolling.stretch(sums, at, at + GRAM)
    marked = (hashes & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)  # ties go to the left one
    place = (_window_minimum(marked, grams) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return hashes[place[first]], first, np.diff(np.append(first, len(place))), place[first] - first


def stretches(size: int, width: int) -> Iterator[tuple[int, int]]:
    """Overlapping stretches such that every window lies in exactly one by its start."""
    for at in range(0, max(0, size - width + 1), BYTES):
        yield at, min(size, at + BYTES + width - 1)


def _text_anchors(text: bytes, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    whole = np.frombuffer(text, np.uint8)
    for a, b in stretches(len(whole), width):
        gram, first, windows, place = anchors(whole[a:b], width)
        yield gram, first + a, windows, place


def _groups(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram, text number, first, windows, place) of all texts; short ones are handled together."""
    held, size = [], 0

    def settle():
        joined = np.frombuffer(b"".join(texts[i] for i in held), np.uint8)
        sizes = np.array([len(texts[i]) for i in held])
        ends = np.cumsum(sizes)
        if len(joined) < width:
            return
        gram, first, windows, place = anchors(joined, width)
        # windows that cross from one text into the next are cut off
        owner = np.searchsorted(ends, first, side="right")
        last = first + windows - 1
        split = np.searchsorted(ends, last, side="right") != owner
        pieces = [(gram[~split], owner[~split], first[~split], windows[~split], place[~split])]
        for g, o, f, w, p in zip(*(x[split].tolist() for x in (gram, owner, first, windows, place))):
            row = []
            while w > 0 and o < len(ends):
                n = min(w, int(ends[o]) - f)
                if n > 0:
                    row.append((g, o, f, n, p))
                    f, w, p = f + n, w - n, p - n
                o += 1
            if row:
                pieces.append(tuple(np.array(c, np.uint64 if i == 0 else np.int64) for i, c in enumerate(zip(*row))))
        gram, owner, first, windows, place = (np.concatenate(x) for x in zip(*pieces))
        own_first = first - (ends - sizes)[owner]
        windows = np.minimum(windows, sizes[owner] - width + 1 - own_first)
        keep = windows > 0
        yield gram[keep], np.array(held)[owner[keep]], own_first[keep], windows[keep], place[keep]

    for i, text in enumerate(texts):
        if len(text) < width:
            continue
        if len(text) > BYTES:
            for gram, first, windows, place in _text_anchors(text, width):
                yield gram, np.full(len(gram), i), first, windows, place
            continue
        if held and size + len(text) > BYTES:
            yield from settle()
            held, size = [], 0
        held.append(i)
        size += len(text)
    if held:
        yield from settle()


def bytes_key(data: bytes) -> int:
    """64 bits for a whole string."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_ANCHOR = (("gram", np.uint64), ("tid", np.int64), ("first", np.int64), ("windows", np.int16), ("place", np.int16))
_ROW = "gram long, tid long, first long, windows int, place int"


def _rows(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(parts[0]), 100_000):
        gram, tid, first, windows, place = (x[at : at + 100_000] for x in parts)
        yield arrow_rows({"gram": (gram.view(np.int64), pa.int64()), "tid": (tid, pa.int64()), "first": (first, pa.int64()), "windows": (windows.astype(np.int32), pa.int32()), "place": (place.astype(np.int32), pa.int32())})


def _find(width: int, buckets: int):
    """Anchors as packed rows by bucket; under bucket -1 those known here to be shared.

    A bucket holds at most ``FREQUENT`` entries of a gram from each task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_bytes(t) for t in batch.column(0).to_pylist()]
            keys = np.array([bytes_key(t) for t in texts], np.int64)
            once = np.unique(keys, return_index=True)[1].tolist()  # copies in a batch count once here; see ``copies``
            found = list(_groups([texts[i] for i in once], width))
            if not found:
                continue
            gram, owner, first, windows, place = (np.concatenate(x) for x in zip(*found))
            tid = keys[np.array(once)][owner]
            order = np.argsort(gram, kind="stable")
            parts = [x[order] for x in (gram, tid, first, windows, place)]
            start = np.flatnonzero(np.diff(parts[0], prepend=parts[0][:1] + np.uint64(1)))
            amount = np.diff(np.append(start, len(order)))
            often = np.repeat(amount > FREQUENT, amount)
            nth = np.arange(len(order)) - np.repeat(start, amount)
            where = (rolling.mix(parts[0]) % np.uint64(buckets)).astype(np.int64)
            for chosen, sent in ((~often, where), (often & (nth < 2), where), (often, np.full(len(order), -1))):
                at = np.flatnonzero(chosen)
                at = at[np.argsort(sent[at], kind="stable")]
                for group in np.split(at, np.flatnonzero(np.diff(sent[at])) + 1) if len(at) else []:
                    yield arrow_rows({"bucket": ([int(sent[group[0]])], pa.int32())} | {n: ([x[group].astype(t).tobytes()], pa.binary()) for x, (n, t) in zip(parts, _ANCHOR)})

    return work


def _open(rows: dict) -> list[np.ndarray]:
    return [np.frombuffer(rows[n], t) for n, t in _ANCHOR]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a bucket whose gram stands in two places at least."""
    held = [_open(r) for batch in batches for r in batch.to_pylist()]
    if not held:
        return
    parts = [np.concatenate(x) for x in zip(*held)]
    order = np.lexsort((parts[2], parts[1], parts[0]))
    parts = [x[order] for x in parts]
    gram_new = np.concatenate([[True], parts[0][1:] != parts[0][:-1]])
    new = gram_new | np.concatenate([[True], (parts[1][1:] != parts[1][:-1]) | (parts[2][1:] != parts[2][:-1])])
    first = np.flatnonzero(gram_new)
    places = np.add.reduceat(new.astype(np.int64), first)
    keep = new & np.repeat(places >= 2, np.diff(np.append(first, len(order))))
    yield from _rows([x[keep] for x in parts])


def _straight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield from _rows(_open(r))


# --- segments ---------------------------------------------------------------
def _cut(width: int):
    """Segments of each text at its shared anchors. The bytes go along once for each task and segment."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = defaultdict(list)
            spots = batch.column(2)
            sizes = np.diff(spots.offsets.to_numpy())
            flat = spots.flatten()
            columns = {n: flat.field(n) for n in ("gram", "first", "windows", "place")}
            texts = [_bytes(t) for t in batch.column(1).to_pylist()]
            of = np.repeat(np.arange(len(texts)), sizes).tolist()
            keys, pieces = [], []
            for i, gram, first, windows in zip(of, *(columns[n].to_pylist() for n in ("gram", "first", "windows"))):
                piece = texts[i][first : first + windows + width - 1]
                name = (gram, bytes_key(piece))
                keys.append(name[1])
                pieces.append(None if name in seen else piece)
                if len(seen) < SEEN:
                    seen.add(name)
            yield arrow_rows({
                "gram": (columns["gram"], None), "seg": (keys, pa.int64()), "tid": (np.repeat(batch.column(0).to_numpy(), sizes), pa.int64()),
                "first": (columns["first"], None), "windows": (columns["windows"], None), "place": (columns["place"], None), "bytes": (pieces, pa.binary()),
            })

    return work


def _recut(width: int, step: int):
    """Pieces of segments: ``step`` windows at the same distance from the anchor, named by the bytes all of them cover."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = defaultdict(list)
            for r in batch.to_pylist():
                a = 0
                while a < r["windows"]:
                    # windows whose anchor distance (place - a) falls into one range of step
                    b = min(r["windows"], a + (r["place"] - a) % step + 1)
                    piece = r["bytes"][a : b + width - 1]
                    lowest = a - (step - 1 - (r["place"] - a) % step)  # first window of the whole range
                    core = r["bytes"][max(0, lowest + step - 1) : lowest + width]
                    own = f"{r['gram']}/{(r['place'] - a) // step}/".encode()
                    for column, value in zip(
                        ("gram", "seg", "up_gram", "up_seg", "shift", "windows", "place", "bytes"),
                        (bytes_key(own + core), bytes_key(own + b"/%d/" % (r["place"] - a) + piece), r["gram"], r["seg"], a, b - a, r["place"] - a, piece),
                    ):
                        out[column].append(value)
                    a = b
            if out:
                kinds = {"shift": pa.int32(), "windows": pa.int32(), "place": pa.int32(), "bytes": pa.binary()}
                yield arrow_rows({c: (v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return work


def _sort_blocks(width: int):
    """(gram, seg, from, to): runs of windows that occur in several strings. Whole grams stay in one block.

    Rows come in order of gram and seg; a string may come several times.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size, last = 0, (None, None)

        def settle():
            out = defaultdict(list)
            flags = suffixes.repeated_windows([r[2] for r in block], width)
            for (gram, seg, _), again in zip(block, flags):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
                for a, b in edge.reshape(-1, 2).tolist():
                    for column, value in zip(("gram", "seg", "from", "to"), (gram, seg, a, b)):
                        out[column].append(value)
            kinds = {"from": pa.int32(), "to": pa.int32()}
            return arrow_rows({c: (out[c], kinds.get(c, pa.int64())) for c in ("gram", "seg", "from", "to")})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] == last:
                    continue
                if size > BLOCK and row[0] != last[0]:
                    yield settle()
                    block, size = [], 0
                block.append(row)
                size, last = size + len(row[2]), row[:2]
        if block:
            yield settle()

    return work


def _sorted_runs(strings: DataFrame, width: int) -> DataFrame:
    """``strings``: gram, seg, bytes. All strings of a gram meet in one task, which sorts block after block."""
    gathered = strings.repartition("gram").sortWithinPartitions("gram", "seg")
    return per_partition(gathered, _sort_blocks(width), "gram long, seg long, from int, to int")


def _repeated(segments: DataFrame, width: int) -> DataFrame:
    """(gram, seg, from, to) of all segments with windows that occur again."""
    runs, ups = [], []
    level = segments
    for depth in range(len(STEPS) + 1):
        counts = durable(level.groupBy("gram", "seg").agg(F.count("*").alias("n"), F.max("windows").alias("windows")), "strings")
        # copies of a whole string repeat in all its windows
        copies = counts.where("n > 1").select("gram", "seg", F.lit(0).alias("from"), F.col("windows").alias("to"))
        several = durable(counts.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"), "grams")
        last = depth == len(STEPS)
        here = several if last else several.where(F.col("k") <= MANY)
        many = None if last else durable(several.where(F.col("k") > MANY).select("gram"), "many")
        last = last or many.isEmpty()
        # the filter may let other grams pass: theirs is one string, sorted in vain, or they are to be cut and are taken out by a join
        strings = passing(level.where("bytes IS NOT NULL").select("gram", "seg", "bytes"), "gram", bit_filter(here, "gram"))
        found = _sorted_runs(strings if last else strings.join(many, "gram", "left_anti"), width).union(copies)
        for up in reversed(ups):  # runs of pieces become runs of the strings they were cut from
            found = found.join(up, ["gram", "seg"]).select(
                F.col("up_gram").alias("gram"), F.col("up_seg").alias("seg"), (F.col("from") + F.col("shift")).alias("from"), (F.col("to") + F.col("shift")).alias("to")
            )
        runs.append(durable(found.distinct(), "runs"))
        if last:
            break
        wide = level.where("bytes IS NOT NULL").join(many, "gram", "left_semi").dropDuplicates(["gram", "seg"])
        cut = "gram long, seg long, up_gram long, up_seg long, shift int, windows int, place int, bytes binary"
        level = durable(per_partition(wide.select("gram", "seg", "windows", "place", "bytes"), _recut(width, STEPS[depth]), cut), "pieces")
        ups.append(level.select("gram", "seg", "up_gram", "up_seg", "shift"))
    out = runs[0]
    for r in runs[1:]:
        out = out.union(r)
    return out


# --- the operator -----------------------------------------------------------
def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [_bytes(t) for t in batch.column(0).to_pylist()]
        yield arrow_rows({"tid": ([bytes_key(t) for t in texts], pa.int64()), "size": ([len(t) for t in texts], pa.int64())})


def spans(texts: DataFrame, width: int = 200) -> DataFrame:
    """(tid, spans array<struct<from, to>>): the byte ranges to remove, by text key. ``texts``: column text."""
    sc = texts.sparkSession.sparkContext
    keys = durable(per_partition(texts.select("text"), _with_key, "tid long, size long"), "texts")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first().s
    buckets = max(sc.defaultParallelism, ceil_div(2 * total // (width - GRAM) + 1, BUCKET_ANCHORS))
    copies = keys.groupBy("tid").agg(F.count("*").alias("k"), F.max("size").alias("size")).where("k > 1")
    packed = "bucket int, " + ", ".join(f"{n} binary" for n, _ in _ANCHOR)
    found = durable(per_partition(texts.select("text"), _find(width, buckets), packed), "anchors")
    shared = per_partition(found.where("bucket >= 0").repartition(buckets, "bucket"), _shared, _ROW).union(
        per_partition(found.where("bucket < 0"), _straight, _ROW)
    ).distinct()
    spots = durable(shared.groupBy("tid").agg(F.collect_list(F.struct("gram", "first", "windows", "place")).alias("spots")), "spots")
    wanted = passing(texts.select("text"), "tid", bit_filter(spots, "tid"), before=(add_key,), schema="tid long, text string").dropDuplicates(["tid"])
    segments = durable(
        per_partition(wanted.join(spots, "tid").select("tid", "text", "spots"), _cut(width), "gram long, seg long, tid long, first long, windows int, place int, bytes binary"),
        "segments",
    )
    runs = _repeated(segments, width)
    places = segments.select("gram", "seg", "tid", "first").join(runs, ["gram", "seg"]).select(
        "tid", (F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to") + F.lit(width - 1)).alias("to")
    )
    ranges = places.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))
    whole = copies.select("tid", F.when(F.col("size") >= width, F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("size").alias("to")))).alias("whole")).where("whole IS NOT NULL")
    return durable(ranges.join(whole, "tid", "full").select("tid", F.coalesce("whole", "spans").alias("spans")), "spans")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted ranges that overlap or touch."""
    out: list[list[int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _outside(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in ranges:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _no_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        none = pa.nulls(len(batch), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))
        yield pa.RecordBatch.from_arrays([*batch.columns, none], names=[*batch.schema.names, "spans"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = defaultdict(list)
        at = {n: batch.schema.get_field_index(n) for n in ("text", "spans")}
        for text, found in zip(batch.column(at["text"]).to_pylist(), batch.column(at["spans"]).to_pylist()):
            data, ranges = _bytes(text), merged([(r["from"], r["to"]) for r in found or []])
            kept = _outside(data, ranges)
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(kept))
            out["n_spans"].append(len(ranges))
            out["kept"].append(kept)
        columns = [(c, pa.array(out[c], t)) for c, t in (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()))]
        rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in ("tid", "spans", "text")]
        yield pa.RecordBatch.from_arrays([c for _, c in rest + columns], names=[n for n, _ in rest + columns])


def kept_bytes(docs: DataFrame, width: int = 200, after: tuple = (), schema: str | None = None) -> DataFrame:
    """The columns of ``docs`` except text, and n_bytes, n_removed, n_spans, kept (binary).

    ``docs`` has a column text. Documents that lose nothing are not shuffled.
    ``after`` are further steps in the same worker, which give ``schema``.
    """
    found = spans(docs, width)
    bits, with_key = bit_filter(found, "tid"), "tid long, " + ddl(docs)
    schema = schema or ", ".join(x for x in (ddl(docs.drop("text")), "n_bytes long, n_removed long, n_spans long, kept binary") if x)
    hit = passing(docs, "tid", bits, before=(add_key,), schema=with_key).join(found, "tid", "left")
    clean = passing(docs, "tid", ~bits, before=(add_key,), after=(_no_spans, _apply, *after), schema=schema)
    return per_partition(hit.select("tid", *docs.columns, "spans"), chain(_apply, *after), schema).union(clean)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    done = kept_bytes(narrow, width)
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, text_col: str = "text", width: int = 200) -> DataFrame:
    """``docs`` with the repeated bytes taken out of its texts; a null text stays null.

    A cut may fall inside a character; the incomplete character is dropped.
    """
    order = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(order)], F.col(f"`{text_col}`").cast("string").alias("text"))
    return kept_bytes(renamed, width, (_to_text(order.index(text_col)),), ddl(renamed.drop("text"))).toDF(*order)


def _to_text(at: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, _, _, _, kept = batch.columns
            old = columns[at].to_pylist()
            columns[at] = pa.array([None if o is None else k.decode("utf-8", "ignore") for o, k in zip(old, kept.to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(columns)])

    return work
