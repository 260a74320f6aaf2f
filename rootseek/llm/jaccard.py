"""N-gram Jaccard join: documents whose word-shingle sets are similar, and their components.

Method: grouped prefix join. Documents with the same set are one group from the
start (so exact copies cost one member). Shingles are ordered rare first; two
sets can only reach the threshold if they share a shingle among the first
``n - ceil(t n) + 1`` of each. Groups that meet in such a prefix shingle are
filtered by size, by the positions of the shared shingle and by marks of fixed
size, and the rest is verified on whole sets. A set's marks say for each class of
hashes whether it holds an odd number of them, so marks that differ in more places
than two linked sets have elements apart rule a pair out, and never a link. Whole
sets are made of documents in a pair that is left.

The order comes from a sketch of fixed size that counts all shingles of all
documents; any order is exact, a rare-first one is fast. Shingles that stand in
one group's prefix only cannot link and are dropped by a packed shuffle.

Only components are asked for, so a shingle shared by many groups is not
expanded into pairs at once. Shingles with up to ``SMALL`` groups give all their
pairs. A larger one first gives the pairs of one leader with the rest; after
verification, pairs remain only across components. New leaders are drawn while
that shrinks the pairs that remain; then all of them are verified. No pair
across components is left out, so the components are exact. Sets are compared
by 48 bits of 64-bit shingle hashes.

Defined cases: a null or empty text, or one without words, has size 0 and is
linked with nothing; a text with fewer words than a shingle is one shingle;
equal ids stay separate rows, each with its own text; an empty table gives an
empty result; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootseek.llm import shingles
from rootseek.llm.common import arrow_rows, ceil_div, chain, durable, per_partition
from rootseek.llm.components import components
from rootseek.llm.rolling import mix

#: Counters of the frequency sketch (one byte each when broadcast), and of one row of it in the shuffle.
SKETCH, SKETCH_ROW = 1 << 22, 1 << 16
#: A counter's level: LEVELS steps per doubling.
LEVELS = 8
#: Prefix entries per bucket of the packed shuffle: about 12 MB, sorted in one worker.
BUCKET_ENTRIES = 500_000
#: Estimated groups from which a shingle skips the packed shuffle, besides the sketch's mean.
FREQUENT = 1024
#: Groups up to which a shingle gives all pairs.
SMALL = 24
#: Rounds of leaders at most, and remaining pairs per prefix entry at which rounds end early.
LEADER_ROUNDS, FEW_PAIRS = 4, 1
#: Bits of the filters by which documents are picked: 1 MB.
FILTER_BITS = 1 << 23
#: Longs of a set's marks, and their columns.
MARKS = 8
MARK_COLUMNS = [f"b{i}" for i in range(MARKS)]


# --- the order --------------------------------------------------------------
def _sketch(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for found in shingles.sets(batch.column(0).to_pylist(), width):
                np.add.at(total, (found % np.uint64(SKETCH)).astype(np.int64), np.uint32(1))
        for i, row in enumerate(total.reshape(-1, SKETCH_ROW)):
            if row.any():
                size = np.uint8 if row.max() < 256 else np.uint32
                yield arrow_rows({"i": ([i], pa.int32()), "wide": ([size is np.uint32], pa.bool_()), "counts": ([row.astype(size).tobytes()], pa.binary())})

    return work


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.frombuffer(row["counts"], np.uint32 if row["wide"] else np.uint8)
            have = totals.setdefault(row["i"], np.zeros(SKETCH_ROW, np.int64))
            have += counts
    for i, have in totals.items():
        level = np.minimum(255, np.round(LEVELS * np.log2(1.0 + have))).astype(np.uint8)
        yield arrow_rows({"i": ([i], pa.int32()), "levels": ([level.tobytes()], pa.binary()), "total": ([int(have.sum())], pa.int64())})


def frequency_levels(texts: DataFrame, width: int, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(level of each counter, shingles in all): a fixed-size summary of all documents."""
    rows = per_partition(texts.select(F.col(text_col).cast("string")), _sketch(width), "i int, wide boolean, counts binary")
    added = per_partition(rows.repartition(SKETCH // SKETCH_ROW, "i"), _add_rows, "i int, levels binary, total long").collect()
    levels = np.zeros(SKETCH, np.uint8)
    for r in added:
        levels[r.i * SKETCH_ROW : (r.i + 1) * SKETCH_ROW] = np.frombuffer(r.levels, np.uint8)
    return levels, sum(r.total for r in added)


# --- prefixes ---------------------------------------------------------------
def prefix_size(n: int, percent: int) -> int:
    return n - ceil_div(percent * n, 100) + 1 if n else 0


def set_key(found: np.ndarray) -> int:
    """64 bits for a whole set, by a sum and a mixed sum of its hashes."""
    if not len(found):
        return 0
    sums = np.array([found.sum(dtype=np.uint64), np.bitwise_xor.reduce(found * np.uint64(0xD6E8FEB86659FD93))])
    return int(mix(sums[:1] ^ (sums[1:] * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)[0])


def parities(found: np.ndarray) -> np.ndarray:
    """The marks of a set: whether each class of hashes, by their leading bits, holds an odd number."""
    classes = ((found >> np.uint64(32)) * np.uint64(64 * MARKS) >> np.uint64(32)).astype(np.int64)
    return np.packbits(np.bincount(classes, minlength=64 * MARKS).astype(np.uint8) & 1).view(np.int64)


def _prefixes(sent, width: int, percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in batches:
            sizes, keys, heads, marks = [], [], [], np.zeros((batch.num_rows, MARKS), np.int64)
            texts = [text_key(t) for t in batch.column(1).to_pylist()]
            for i, found in enumerate(shingles.sets(batch.column(1).to_pylist(), width)):
                order = np.lexsort((found, levels[(found % np.uint64(SKETCH)).astype(np.int64)]))
                sizes.append(len(found))
                keys.append(set_key(found))
                heads.append(found[order[: prefix_size(len(found), percent)]].tobytes())
                marks[i] = parities(found)
            yield arrow_rows({
                "id": (batch.column(0), None), "tid": (texts, pa.int64()), "n": (sizes, pa.int32()), "gid": (keys, pa.int64()), "head": (heads, pa.binary()),
            } | {name: (marks[:, i], pa.int64()) for i, name in enumerate(MARK_COLUMNS)})

    return work


def _entries(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(token, gid, n, pos) of all prefix entries of a batch."""
    heads = [np.frombuffer(h, np.uint64) for h in rows.column(2).to_pylist()]
    sizes = np.array([len(h) for h in heads], np.int64)
    repeat = lambda c: np.repeat(rows.column(c).to_numpy(), sizes)
    pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.concatenate(heads) if heads else np.zeros(0, np.uint64), repeat(0), repeat(1), pos.astype(np.int32)


_PARTS = (("token", np.uint64), ("gid", np.int64), ("n", np.int32), ("pos", np.int32))


def _route(sent, buckets: int, frequent_level: int):
    """Entries as packed rows by bucket; those of frequent shingles go straight on, under bucket -1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in batches:
            entries = _entries(batch)
            where = (mix(entries[0]) % np.uint64(buckets)).astype(np.int64)
            where[levels[(entries[0] % np.uint64(SKETCH)).astype(np.int64)] >= frequent_level] = -1
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            for at in np.split(order, cuts) if len(order) else []:
                yield arrow_rows({"bucket": ([int(where[at[0]])], pa.int32())} | {name: ([e[at].astype(t).tobytes()], pa.binary()) for e, (name, t) in zip(entries, _PARTS)})

    return work


def _unpacked(rows: dict) -> list[np.ndarray]:
    return [np.frombuffer(rows[name], t) for name, t in _PARTS]


def _plain(entries: list[np.ndarray], **more: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(entries[0]), 100_000):
        token, gid, n, pos = (e[at : at + 100_000] for e in entries)
        yield arrow_rows({"token": (token.view(np.int64), pa.int64()), "gid": (gid, pa.int64()), "n": (n, pa.int32()), "pos": (pos, pa.int32())} | {name: (e[at : at + 100_000], pa.int64()) for name, e in more.items()})


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in batch.to_pylist():
            yield from _plain(_unpacked(rows))


def _keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of shingles that stand in k >= 2 groups' prefixes; a bucket has ``BUCKET_ENTRIES`` on average."""
    held = [_unpacked(rows) for batch in batches for rows in batch.to_pylist()]
    if not held:
        return
    entries = [np.concatenate(x) for x in zip(*held)]
    order = np.lexsort((entries[1], entries[0]))
    token, gid = entries[0][order], entries[1][order]
    new_token = np.concatenate([[True], token[1:] != token[:-1]])
    new_entry = new_token | np.concatenate([[True], gid[1:] != gid[:-1]])  # copies repeat an entry
    first = np.flatnonzero(new_token)
    groups = np.add.reduceat(new_entry.astype(np.int64), first)
    groups = np.repeat(groups, np.diff(np.append(first, len(token))))
    keep = new_entry & (groups >= 2)
    yield from _plain([e[order[keep]] for e in entries], k=groups[keep])


# --- candidates -------------------------------------------------------------
def _fits(percent: int, a: str = "n", b: str = "m") -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _need(percent: int, a: str = "n", b: str = "m") -> str:
    """Common shingles that two sets of these sizes need: the smallest o with 100 o >= percent (a + b - o)."""
    return f"ceil({percent} * (cast({a} as long) + {b}) / {100 + percent})"


def _reach(a: str = "pos", b: str = "qos", n: str = "n", m: str = "m") -> str:
    """Most common shingles of two sets whose first shared shingle stands at these positions.

    Two sets that link have a first one, so a pair may be judged at each of its
    shared shingles as if that were the first.
    """
    return f"1 + least({n} - {a} - 1, {m} - {b} - 1)"


def _alike(percent: int) -> str:
    """Whether the marks of two sets allow a link: each place that differs is an element that only one set has."""
    apart = " + ".join(f"bit_count({c} ^ {c}_2)" for c in MARK_COLUMNS)
    return f"{apart} <= cast(n as long) + m - 2 * {_need(percent)}"


def _more(entries: DataFrame) -> list[str]:
    return [c for c in entries.columns if c not in ("token", "gid", "n", "pos")]


def _with_other(entries: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Pairs (gid, hid) that meet in a shingle; both inputs have token, gid, n, pos and the same further columns."""
    right = others.select("token", F.col("gid").alias("hid"), F.col("n").alias("m"), F.col("pos").alias("qos"), *[F.col(c).alias(f"{c}_2") for c in _more(others)])
    met = entries.join(right, "token").where("gid <> hid").where(_fits(percent)).where(f"{_reach()} >= {_need(percent)}")
    return met.where(_alike(percent)) if MARK_COLUMNS[0] in entries.columns else met


def _leaders(entries: DataFrame, seed: int) -> DataFrame:
    """One entry of each shingle; the partial minimum runs before the shuffle.

    It is drawn by hash if ``seed`` is odd. Else it is one before whose shingle the fewest
    rarer ones stand: of texts made from one, such a text is nearest to most of the others.
    """
    first = F.lit(0) if seed % 2 else F.col("pos")
    rank = F.struct(first.alias("p"), F.xxhash64("gid", F.lit(seed)).alias("r"), "gid", "n", "pos", *_more(entries))
    return entries.groupBy("token").agg(F.min(rank).alias("l")).select("token", "l.gid", "l.n", "l.pos", *[f"l.{c}" for c in _more(entries)])


def _as_pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("gid", "hid").alias("a"), F.greatest("gid", "hid").alias("b")).distinct()


def _alike_pairs(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The pairs that marks do not rule out. ``groups``: gid, n, marks."""
    pairs = durable(pairs, "met")
    picked = passing(groups, "gid", bit_filter(_ends(pairs), "gid"))
    left = picked.select(F.col("gid").alias("a"), "n", *MARK_COLUMNS)
    right = picked.select(F.col("gid").alias("b"), F.col("n").alias("m"), *[F.col(c).alias(f"{c}_2") for c in MARK_COLUMNS])
    return pairs.join(left, "a").join(right, "b").where(_alike(percent)).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("gid")).union(pairs.select(F.col("b").alias("gid")))


def _xxhash64(ids: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of one long column."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = (turned(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1) ^ (p5 + np.uint64(42 + 8))
    h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def bit_filter(ids: DataFrame, col: str) -> np.ndarray:
    """A filter of fixed size that passes at least all given ids, by bits of their hashes."""
    bit = f"pmod(xxhash64(coalesce(cast({col} as long), 0L)), {FILTER_BITS})"
    words = ids.select(F.expr(f"cast({bit} div 32 as int)").alias("w"), F.expr(f"shiftleft(1L, cast({bit} % 32 as int))").alias("b"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # FILTER_BITS / 32 rows at most
        out[r.w] = r.b
    return out


def passing(df: DataFrame, col: str, bits: np.ndarray, before: tuple = (), after: tuple = (), schema: str | None = None) -> DataFrame:
    """Rows whose id the filter passes, tested before any shuffle. Steps before and after run in the same worker."""
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(col)).fill_null(0).to_numpy(zero_copy_only=False)
            bit = np.mod(_xxhash64(ids), FILTER_BITS)
            yield batch.filter(pa.array((words[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1))

    return per_partition(df, chain(*before, work, *after), schema or ddl(df))


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


# --- verification -----------------------------------------------------------
def _whole_sets(width: int):
    """(gid, words binary): the upper 48 bits of each hash, ascending."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = [], []
            for found in shingles.sets(batch.column(batch.schema.get_field_index("text")).to_pylist(), width):
                keys.append(set_key(found))
                data.append(_to_48(found >> np.uint64(16)))
            yield arrow_rows({"gid": (keys, pa.int64()), "words": (data, pa.binary())})

    return work


def _to_48(x: np.ndarray) -> bytes:
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _from_48(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common elements of two ascending arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _verify(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep, last = batch.column(0), batch.column(1), [], (None, None)
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x = last[1] if last[0] == left else _from_48(left)
                last, y = (left, x), _from_48(right)
                common = _overlap(x, y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return work


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold, written once."""
    left = sets.select(F.col("gid").alias("a"), F.col("words").alias("x"))
    right = sets.select(F.col("gid").alias("b"), F.col("words").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return durable(per_partition(both, _verify(percent), "a long, b long"), "linked")


# --- the join ---------------------------------------------------------------
def similar_groups(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """((id, tid, n, gid) of every document, (gid, comp) of every group with a link). ``docs``: id, text."""
    sc = docs.sparkSession.sparkContext
    levels, total = frequency_levels(docs, width)
    sent = sc.broadcast(levels)
    marks = "".join(f", {c} long" for c in MARK_COLUMNS)
    heads = durable(per_partition(docs, _prefixes(sent, width, percent), "id long, tid long, n int, gid long, head binary" + marks), "prefixes")
    buckets = max(sc.defaultParallelism, ceil_div(total * (100 - percent) // 100 + 1, BUCKET_ENTRIES))
    frequent = min(255, int(LEVELS * np.log2(1 + FREQUENT + 4 * total / SKETCH)))
    packed = per_partition(heads.where("n > 0").select("gid", "n", "head"), _route(sent, buckets, frequent), "bucket int, token binary, gid binary, n binary, pos binary")
    schema = "token long, gid long, n int, pos int"
    shared = per_partition(packed.where("bucket >= 0").repartition(buckets, "bucket"), _keep_shared, schema + ", k long")
    straight = durable(per_partition(packed.where("bucket < 0"), _spread, schema).distinct(), "frequent")
    sizes = straight.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    entries = durable(shared.union(straight.join(sizes, "token").select("token", "gid", "n", "pos", "k")), "entries")
    groups = durable(_groups(heads, entries), "groups")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = durable(pairs, "pairs")
        return pairs if pairs.isEmpty() else verified(pairs, _one_set_each(docs, heads, _documents_of(pairs, groups), width), percent)

    small, large = entries.where(F.col("k") <= SMALL).drop("k"), entries.where(F.col("k") > SMALL).drop("k")
    met = _with_other(small, small, percent).where("gid < hid").select("gid", "hid").union(
        _with_other(large, _leaders(large, 0), percent).select("gid", "hid")
    )
    links = linked(_alike_pairs(_as_pairs(met), groups, percent))
    comps = components(links)
    for seed in range(1, LEADER_ROUNDS + 1):
        joined = large.join(comps.withColumnRenamed("node", "gid"), "gid", "left").select("token", "gid", "n", "pos", F.coalesce("component", "gid").alias("comp"))
        # shingles whose groups are all in one component have nothing left to give
        spread = joined.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(
            F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"), F.max("k").alias("most")
        ).where("all * all > same")
        spread = durable(spread, "open")
        left = spread.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2), F.lit(0)).alias("p"), F.coalesce(F.sum("all"), F.lit(0)).alias("e")).first()
        if not left.p:
            break
        open_ = durable(joined.join(spread.select("token"), "token").join(groups.select("gid", *MARK_COLUMNS), "gid"), "open-entries")
        last = seed == LEADER_ROUNDS or left.p <= FEW_PAIRS * left.e
        if last:
            met = _with_other(open_, open_, percent).where("gid < hid AND comp <> comp_2")
        else:
            met = _with_other(open_, _leaders(open_, seed), percent).where("comp <> comp_2")
        links = links.union(linked(_as_pairs(met)))
        comps = components(links)
        if last:
            break
    return heads.select("id", "tid", "n", "gid"), comps


def _groups(heads: DataFrame, entries: DataFrame) -> DataFrame:
    """(gid, id, n, marks) of each group that has an entry; the id is the smallest of its documents."""
    same = heads.where("n > 0").groupBy("gid").agg(F.min("id").alias("id"), F.max("n").alias("n"), *[F.max(c).alias(c) for c in MARK_COLUMNS])
    return same.join(entries.select("gid").distinct(), "gid", "left_semi")


def _documents_of(pairs: DataFrame, groups: DataFrame) -> np.ndarray:
    """A filter of documents: one of each group in a pair, and those it cannot tell from it."""
    return bit_filter(groups.select("gid", "id").join(_ends(pairs).distinct(), "gid", "left_semi"), "id")


def _one_set_each(docs: DataFrame, heads: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """(gid, words) of the documents that pass, once for each group; only groups of which several pass are shuffled."""
    sets = durable(passing(docs, "id", bits, after=(_whole_sets(width),), schema="gid long, words binary"), "sets")
    several = bit_filter(passing(heads.select("id", "gid"), "id", bits).groupBy("gid").agg(F.count("*").alias("k")).where("k > 1"), "gid")
    if not several.any():
        return sets
    once = durable(passing(sets, "gid", several).dropDuplicates(["gid"]), "sets-once")
    return passing(sets, "gid", ~several).union(once)


def text_key(text: str | None) -> int:
    """64 bits for a whole text."""
    return int.from_bytes(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def join(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document; the component is its smallest id.

    Two documents link if 100 * common shingles >= ``percent`` * shingles in either.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found, comps = similar_groups(narrow, percent, width)
    placed = found.join(comps.withColumnRenamed("node", "gid"), "gid", "left").select("id", "n", F.coalesce("component", "gid").alias("comp"))
    least = placed.where("n > 0").groupBy("comp").agg(F.min("id").alias("least"))
    whole = placed.where("n > 0").join(least, "comp").select("id", "n", "least").union(placed.where("n = 0").select("id", "n", F.col("id").alias("least")))
    return whole.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"))


def add_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the key ``tid`` of their column text in front."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([text_key(t) for t in texts], pa.int64()), *batch.columns], names=["tid", *batch.schema.names])


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the smallest id, then the smallest text key.

    Rows without words all stay. Rows are told apart by id and text; of rows that
    agree in both one stays. Documents that stay are not shuffled.
    """
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found, comps = similar_groups(plain.select("id", "text"), percent, width)
    worded = found.where("n > 0").join(comps.withColumnRenamed("node", "gid"), "gid", "left").select("id", "tid", F.coalesce("component", "gid").alias("comp"))
    rows = worded.groupBy("comp", "id", "tid").agg(F.count("*").alias("k"))  # equal rows fold before the shuffle
    best = rows.groupBy("comp").agg(F.min(F.struct("id", "tid")).alias("best"))
    judged = rows.join(best, "comp").select("id", "tid", (F.struct("id", "tid") == F.col("best")).alias("stays"), "k")
    marked = durable(judged.where("NOT stays OR k > 1").select("id", "tid", "stays"), "judged")
    bits, schema = bit_filter(marked, "tid"), "tid long, " + ddl(plain)
    touched = passing(plain, "tid", bits, before=(add_key,), schema=schema).join(marked, ["id", "tid"], "left")
    single = touched.where("stays").dropDuplicates(["id", "tid"])
    kept = passing(plain, "tid", ~bits, before=(add_key,), schema=schema)
    columns = [f"c{i}" for i in range(len(names))]
    return kept.select(*columns).union(touched.where("stays IS NULL").select(*columns)).union(single.select(*columns)).toDF(*names)
