"""Language identification by mixtures: expectation-maximisation over n-gram likelihoods.

Learning counts hashed letter trigrams per language over all labelled
documents. A text is a sequence of words; a word's likelihood in a language is
the product over its trigrams (with a blank at either end). For every document,
expectation-maximisation finds the proportions of languages that explain its words
best. The set of languages is chosen by penalised likelihood: the weakest
language goes as long as the log-likelihood falls by less than the penalty,
``PENALTY`` per language and unit of log(words). All documents of a batch are
treated side by side.

Only text and label take part in learning, only text in prediction.

Defined cases: a null text or one without a letter is ``und`` with score 0; equal
proportions go to the alphabetically first language; if nothing is labelled,
every text is ``und``; equal ids stay separate rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootseek.llm.common import arrow_rows, per_partition

UNKNOWN = "und"
#: Hash buckets of trigrams; the model has 4 bytes for each and each language.
BUCKET_BITS = 16
#: Added to every count.
SMOOTHING = 0.5
#: Rounds of expectation-maximisation.
ROUNDS = 6
PENALTY = 3.0
#: Characters handled at once; a longer text goes in pieces.
CHARS = 1_000_000
#: The language model may have at most so many languages (128 MB).
MOST_LANGUAGES = 512

_tables: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """Code point to the code point of its lower-case letter; 0 for anything else."""
    if not _tables:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables.append(table)
    return _tables[0]


def pieces(text: str) -> list[str]:
    """The text in stretches of about ``CHARS`` characters, cut at blanks."""
    if len(text) <= CHARS:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = text.find(" ", at + CHARS)
        end = len(text) if end < 0 else end
        out.append(text[at:end])
        at = end
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram, first trigram of each word, text of each word)."""
    joined = " ".join(texts) + " "
    letters = letter_codes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    padded = np.concatenate([np.zeros(1, np.uint32), letters, np.zeros(1, np.uint32)])
    mid = letters != 0
    first = np.flatnonzero(mid & (padded[:-2] == 0))
    at = np.flatnonzero(mid)
    with np.errstate(over="ignore"):
        mixed = padded[at] * np.uint32(0x9E3779B1) + padded[at + 1] * np.uint32(0x85EBCA6B) + padded[at + 2] * np.uint32(0xC2B2AE35)
        mixed ^= mixed >> np.uint32(15)
        bucket = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS)
    starts = np.searchsorted(at, first)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return bucket, starts, np.searchsorted(ends, first, side="right")


def _groups(texts: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Numbered texts in groups of about ``CHARS`` characters."""
    group, size = [], 0
    for i, text in texts:
        for piece in pieces(text):
            if group and size + len(piece) > CHARS:
                yield group
                group, size = [], 0
            group.append((i, piece))
            size += len(piece)
    if group:
        yield group


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BUCKET_BITS, np.int64))
    for batch in batches:
        by_lang = defaultdict(list)
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang[lang].append((0, text))
        for lang, texts in by_lang.items():
            for group in _groups(texts):
                counts[lang] += np.bincount(trigrams([t for _, t in group])[0], minlength=1 << BUCKET_BITS)
    for lang, found in counts.items():
        used = np.flatnonzero(found)
        yield arrow_rows({"lang": (pa.array([lang] * len(used), pa.string()), None), "bucket": (used, pa.int32()), "n": (found[used], pa.int64())})


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each bucket by language) of all labelled rows."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = per_partition(rows, _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.collect()  # languages x buckets rows at most
    langs = sorted({r.lang for r in found})
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; raise MOST_LANGUAGES if workers can hold them")
    counts = np.zeros((len(langs), 1 << BUCKET_BITS))
    place = {lang: i for i, lang in enumerate(langs)}
    for r in found:
        counts[place[r.lang], r.bucket] = r.n
    return langs, np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * (1 << BUCKET_BITS))).astype(np.float32)


def _mix(likely: np.ndarray, owner: np.ndarray, first: np.ndarray, active: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of every document after some rounds, over its active languages. Languages are rows."""
    share = np.where(active, start, 0.0).astype(likely.dtype)
    share /= share.sum(0)
    words = np.diff(np.append(first, len(owner)))
    for _ in range(rounds):
        part = likely * share[:, owner]
        part /= part.sum(0)
        share = np.add.reduceat(part, first, axis=1) / words
    share = share.astype(likely.dtype)
    return share, np.add.reduceat(np.log((likely * share[:, owner]).sum(0)), first, dtype=np.float64)


def mixtures(scores: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Language proportions of every document, a row per language. ``scores``: log-likelihood by language and word; ``owner`` ascends from 0."""
    likely = np.maximum(np.exp(scores - scores.max(0)), 1e-30).astype(np.float32)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    docs, langs = len(first), len(scores)
    active = np.ones((langs, docs), bool)
    share, value = _mix(likely, owner, first, active, np.full((langs, docs), 1.0 / langs), ROUNDS)
    cost = PENALTY * np.log(1 + np.diff(np.append(first, len(owner))))
    open_ = np.arange(docs)
    for _ in range(langs - 1):
        fewer = active[:, open_].copy()
        fewer[np.where(fewer, share[:, open_], np.inf).argmin(0), np.arange(len(open_))] = False
        mine = np.zeros(docs, bool)
        mine[open_] = True
        rows = mine[owner]
        sub_owner = (np.cumsum(mine) - 1)[owner[rows]]
        sub_first = np.flatnonzero(np.diff(sub_owner, prepend=-1))
        try_share, try_value = _mix(likely[:, rows], sub_owner, sub_first, fewer, share[:, open_] + 1e-6, 2)
        better = value[open_] - try_value < cost[open_]
        chosen = open_[better]
        if not len(chosen):
            break
        share[:, chosen], value[chosen], active[:, chosen] = try_share[:, better], try_value[better], fewer[:, better]
        open_ = chosen
    return share


def _predict(model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        for batch in batches:
            values = batch.column(1).to_pylist()
            names, scores = [UNKNOWN] * len(values), [0.0] * len(values)
            if langs:
                held: list[tuple[np.ndarray, np.ndarray]] = []
                groups = list(_groups([(i, t) for i, t in enumerate(values) if t]))
                for at, group in enumerate(groups):
                    bucket, starts, text = trigrams([t for _, t in group])
                    if len(starts):
                        held.append((np.stack([np.add.reduceat(column[bucket], starts) for column in table]), np.array([i for i, _ in group])[text]))
                    goes_on = at + 1 < len(groups) and groups[at + 1][0][0] == group[-1][0]
                    if held and not goes_on:
                        words, owner = np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held])
                        docs, dense = np.unique(owner, return_inverse=True)
                        share = mixtures(words, dense)
                        best = share.argmax(0)
                        for d, b, s in zip(docs.tolist(), best.tolist(), share.max(0).tolist()):
                            names[d], scores[d] = langs[b], min(1.0, max(0.0, s))
                        held = []
            yield arrow_rows({"id": (batch.column(0), None), "lang_pred": (names, pa.string()), "score": (scores, pa.float64())})

    return work


def predict(texts: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    spark = texts.sparkSession
    narrow = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    found = per_partition(narrow, _predict(spark.sparkContext.broadcast(model)), f"id {kind}, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a letter and a language that holds at least ``least`` of the text.

    Without any learned language, all rows with a letter.
    """
    sent, at, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _predict(sent)
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            if sent.value[0]:
                (found,) = judge(iter([pa.RecordBatch.from_arrays([pa.nulls(len(texts)), texts], names=["id", "text"])]))
                keep = [n != UNKNOWN and s >= least for n, s in zip(found.column(1).to_pylist(), found.column(2).to_pylist())]
            else:
                keep = [any(map(str.isalpha, t or "")) for t in texts.to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return per_partition(plain, work, schema).toDF(*names)


def held_out(id_col: str = "doc_id"):
    """The fifth of the ids that learning never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
