"""Byte-level BPE through a sentencepiece model made from the vocabulary.

Method: the ranks become a sentencepiece model of the BPE kind, written in its
serialised form directly. Each token is a piece whose bytes are mapped to one
printable character each, its score is the negative rank, so the best-scored pair
is the pair of lowest rank and ties go to the left, as in byte-level BPE. The
normaliser is the identity and adds no blanks. A text is cut into the matches
of the pre-token pattern; each is encoded by itself. A token of the vocabulary
that merging would not reach is looked up where a whole match equals it.
Decoding maps ids to pieces and their characters back to bytes.

Under the usual pattern, texts are cut before it is tried wherever one blank stands
between two other characters: no match crosses such a place, and none depends on
what is before it. Workers keep the ids of such stretches, in the bounded cache of
``tokens``. Under any other pattern they keep those of its matches.

Defined cases: a null or empty text has no ids and decodes to no bytes; a long
text is encoded whole, stretches over ``LONGEST`` characters are not kept; rows with
equal ids stay separate rows; special strings are plain text; an empty table gives
an empty result; other columns are ignored. An id outside the vocabulary, or a null
one, raises an error when decoded; a null list of ids decodes to null. The
vocabulary must hold all 256 bytes and ranks 0, 1, 2, ... below 2**24, which float
scores tell apart.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain as joined_up

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootseek.llm.common import arrow_rows, chain, per_partition
from rootseek.llm.tokens import WordCache

#: Longest stretch that is looked up whole, and characters of longer matches that a worker keeps.
LONGEST, LONG_CHARS = 128, 10_000_000
#: The pre-token pattern of the public byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that are characters of their own, as the public byte-level vocabularies print them; the others follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

_CUT = re.compile(r"(?<=\S)(?= \S)")
_TWO_BLANKS = re.compile(r"\s\s")


def byte_characters() -> list[str]:
    """The character of each byte."""
    others = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a vocabulary file (base64 and rank in each line) in order of their ranks."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(ranks) != list(range(len(ranks))) or len(ranks) >= 1 << 24:
        raise ValueError(f"{path}: its ranks are not 0 to {len(ranks) - 1}, or too many")
    tokens = [ranks[i] for i in range(len(ranks))]
    if not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError(f"{path}: it lacks single bytes")
    return tokens


# ---- the serialised model ----


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n % 2**64)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose ids are the ranks; the piece that stands for unknown text comes last."""
    marks = byte_characters()
    # fixed values of the format: kinds of pieces (1 ordinary, 2 unknown), model kind 2 for BPE, field numbers
    pieces = [_piece("".join(map(marks.__getitem__, t)), -float(rank), 1) for rank, t in enumerate(tokens)]
    pieces.append(_piece("<unk>", -float(1 << 24), 2))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(24, 0) + _number(40, len(tokens)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normaliser = _block(1, b"identity") + _block(2, b"") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser)


class Codec(WordCache):
    """Encoder and decoder of a worker.

    A cached word is a stretch after a blank, or one with a leading mark: after
    a newline, at the start of a text, or a whole match of the pattern. Stretches
    start with no blank, so the marks are unambiguous.
    """

    NEWLINE, START, MATCH = "\n\t\r"

    def __init__(self, model: bytes, pattern: str, whole: dict[bytes, int]):
        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cuts, self.split = pattern == PATTERN, regex.compile(pattern).findall
        self.marks = dict(enumerate(byte_characters()))
        bytes_of = {ord(c): b for b, c in self.marks.items()}
        size = self.library.get_piece_size() - 1
        self.bytes = [bytes(bytes_of[ord(c)] for c in self.library.id_to_piece(i)) for i in range(size)]
        self.whole = {t.decode("latin-1").translate(self.marks): np.array([i], "<u4").tobytes() for t, i in whole.items()}
        self.single = dict(zip(".,\n", self._matches([".", ",", "\n"])))
        self.long = 0

    def _mapped(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.marks[32])
        return word.encode().decode("latin-1").translate(self.marks)

    def _matches(self, words: list[str]) -> list[bytes]:
        """Ids of whole matches."""
        mapped = list(map(self._mapped, words))
        lists = self.library.encode(mapped, num_threads=1)
        ids = np.fromiter(joined_up.from_iterable(lists), "<u4").tobytes()
        ends = np.cumsum([4 * len(x) for x in lists]).tolist()
        out = [ids[a:b] for a, b in zip([0, *ends], ends)]
        return [self.whole.get(m, x) for m, x in zip(mapped, out)] if self.whole else out

    def words(self, text: str) -> list[str]:
        if not self.cuts:
            return [self.MATCH + w for w in self.split(text)]
        if _TWO_BLANKS.search(text) or text[0].isspace() or text[-1].isspace():
            first, *rest = _CUT.split(text)
            out = [self.START + first, *[p[1:] for p in rest]]
        else:  # a newline between two other characters is a match of its own
            out = (self.START + text.replace("\n", " \n")).split(" ")
        if max(map(len, out)) <= LONGEST:
            return out
        return [w for p in out for w in ([p] if len(p) <= LONGEST else [self.MATCH + m for m in self.split(self._text(p))])]

    def _text(self, word: str) -> str:
        return word if word[0] == self.NEWLINE else word[1:] if word[0] == self.START else " " + word

    def take(self, new: set[str]) -> None:
        if self.long > LONG_CHARS:
            self.known, self.older, self.long = {}, {}, 0
        self.long += sum(len(w) for w in new if len(w) > LONGEST)
        super().take(new)

    def learn(self, new: list[str]) -> None:
        """Put the ids of words into ``known``."""
        wanted: dict[str, list[str]] = {}  # word: its matches
        for word in new:
            mark = word[0]
            if mark == self.MATCH:
                wanted[word] = [word[1:]]
                continue
            plain = word[1:] if mark in self.NEWLINE + self.START else word
            end = plain[-1:] if plain[-1:] in self.single else ""
            stem = plain[:-1] if end else plain
            if stem.isascii() and stem.isalpha():  # letters are one match, with the blank before them
                wanted[word] = [x for x in ("\n" if mark == self.NEWLINE else "", stem if mark in self.NEWLINE + self.START else " " + stem, end) if x]
            else:
                wanted[word] = self.split(self._text(word))
        matches = list({m for ms in wanted.values() for m in ms if m not in self.single})
        ids = dict(zip(matches, self._matches(matches))) | self.single
        self.known.update((w, ids[ms[0]] if len(ms) == 1 else b"".join(map(ids.__getitem__, ms))) for w, ms in wanted.items())

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def data(self, ids: bytes) -> bytes:
        """The bytes of ids in the same form."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Vocabulary:
    """What workers need of a vocabulary, in a bounded form to broadcast: its model, the pattern, tokens beyond merging."""

    def __init__(self, path: str, pattern: str):
        tokens = read_ranks(path)
        self.parts = (serialise(tokens), pattern, {})
        codec = Codec(*self.parts)
        reached = codec.library.encode([t.decode("latin-1").translate(codec.marks) for t in tokens], num_threads=1)
        self.parts[2].update((t, i) for i, (t, ids) in enumerate(zip(tokens, reached)) if ids != [i])

    def __getstate__(self):
        return {"parts": self.parts}

    def codec(self) -> Codec:
        if not hasattr(self, "_codec"):
            self._codec = Codec(*self.parts)
        return self._codec


def _lists(ids: list[bytes]) -> pa.Array:
    """Ids as lists of 32-bit integers."""
    values = np.frombuffer(b"".join(ids), "<i4")
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32), pa.array(values, pa.int32()))


def _encoding(known):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = known.value.codec()
        for batch in batches:
            yield arrow_rows({"id": (batch.column(0), None), "ids": (_lists(codec.encode_all(batch.column(1).to_pylist())), None)})

    return work


def _decoding(known):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = known.value.codec()
        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.flatten(), np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])]).tolist()
            if values.null_count or (len(values) and not 0 <= pa.compute.min(values).as_py() <= pa.compute.max(values).as_py() < len(codec.bytes)):
                raise ValueError("an id is null or not in the vocabulary")
            raw = values.to_numpy().astype("<u4").tobytes()
            data = [codec.data(raw[4 * a : 4 * b]) if x.is_valid else None for x, a, b in zip(lists, ends, ends[1:])]
            yield arrow_rows({"id": (batch.column(0), None), "ids": (lists, None), "data": (data, pa.binary())})

    return work


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda x: hashlib.sha256(x).hexdigest()
    for batch in batches:
        lists, data = batch.column(1), batch.column(2)
        ends, raw = (4 * lists.offsets.to_numpy()).tolist(), lists.values.to_numpy().astype("<u4").tobytes()
        yield arrow_rows({
            "id": (batch.column(0), None), "n_tokens": ([(b - a) // 4 for a, b in zip(ends, ends[1:])], pa.int64()),
            "ids_sha256": ([digest(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.string()), "decoded_sha256": ([digest(x.as_buffer()) for x in data], pa.string()),
        })


def _known(df: DataFrame, path: str, pattern: str):
    return df.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))


def _narrow(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(texts: DataFrame, path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row. ``path`` names the ranks, ``pattern`` tells pre-tokens."""
    known = _known(texts, path, pattern)
    return per_partition(_narrow(texts, id_col, text_col), _encoding(known), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str = PATTERN, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data) of every row of (id, ids): the bytes, which need not be whole characters."""
    known = _known(encoded, path, pattern)
    narrow = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return per_partition(narrow, _decoding(known), "id long, ids array<int>, data binary").select(F.col("id").alias(id_col), "data")


def round_trip(texts: DataFrame, path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, digests of the ids and of the decoded bytes): encoding and decoding in one worker, nothing shuffled."""
    known = _known(texts, path, pattern)
    work = chain(_encoding(known), _decoding(known), _digests)
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return per_partition(_narrow(texts, id_col, text_col), work, schema).withColumnRenamed("id", id_col)
