"""SentencePiece encoding and decoding over a trie of distinct words.

Method: shared-prefix Viterbi. The distinct marked words of a batch are sorted,
which is the depth-first order of their trie; the forward state of every
prefix stays on a stack, and a word begins where its common prefix with the word before
ends. For a unigram model the state is the best score of a segmentation of the
prefix. For a merge (BPE) model, whose pieces carry merge ranks and not
probabilities, the best score would not give the model's own segmentation;
there the state is the last piece of the prefix's encoding: a piece may follow
another one if the two, merged by rank, stay these two. Exactly one piece that ends at
a position qualifies, so the recurrence is the same with "may follow" in the
place of "scores best".

Defined cases: null and empty texts have no ids and decode to the empty text;
characters outside the vocabulary become their bytes if the model has byte
pieces, else the unknown id; equal ids stay separate rows; columns other than
the two named ones are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootseek.llm import tokens
from rootseek.llm.common import arrow_rows, kept, per_partition

MARK = "▁"
#: Pairs of pieces whose order under merging is remembered.
PAIRS = 2_000_000


class PieceEncoder(tokens.WordCache):
    """Marked words to ids, for one model file."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        m = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        plain = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.piece = {m.id_to_piece(i): i for i in plain}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.longest = max(map(len, self.piece))
        # merge models score pieces by rank, in whole numbers
        self.merges = all(s == int(s) for s in self.score.values())
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in range(size) if m.is_byte(i)}
        self.unknown = m.unk_id()
        letters = {c for p in self.piece for c in p} - {MARK}
        known = "".join(map(re.escape, sorted(letters)))
        crossing = any(MARK in p.lstrip(MARK) for p in self.piece)
        # no piece holds a mark behind a letter, nor an unknown character: words end there
        self.word = re.compile(f"[{known}{MARK}]+|(?s:.)" if crossing else f"{MARK}+[{known}]*|[{known}]+|(?s:.)")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.surface = [self._bytes(i, plain_ids) for plain_ids in [set(plain)] for i in range(size)]

    def _bytes(self, i: int, plain: set[int]) -> bytes:
        m = self.model
        if i in plain or m.is_unused(i):
            return m.id_to_piece(i).replace(MARK, " ").encode()
        if m.is_byte(i):
            return bytes([int(m.id_to_piece(i)[3:5], 16)])
        return " ⁇ ".encode() if m.is_unknown(i) else b""

    # --- states -----------------------------------------------------------
    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, merged by rank, leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = self.merged(left + right) == [p for p in key if p]
        return self.pairs[key]

    def _extend(self, word: str, end: int, last: list, best: list) -> None:
        """Forward state of ``word[:end]`` from those of its shorter prefixes."""
        pick, top = None, None
        for size in range(min(end, self.longest), 0, -1):
            p = word[end - size : end]
            if p not in self.piece and size > 1:
                continue
            if self.merges:
                if p not in self.piece or self.may_follow(last[end - size] if end > size else "", p):
                    pick, top = p, 0.0
                    break
            else:
                value = best[end - size] + self.score.get(p, -1e6)
                if top is None or value > top:
                    pick, top = p, value
        last.append(pick)
        best.append(top)

    def _ids(self, p: str) -> list[int]:
        if p in self.piece:
            return [self.piece[p]]
        return [self.byte[b] for b in p.encode()] if self.byte else [self.unknown]

    def learn(self, new: list[str]) -> None:
        before, last, best = "", [""], [0.0]
        for word in sorted(new):
            shared = len(commonprefix((before, word)))
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                self._extend(word, end, last, best)
            found, at = [], len(word)
            while at:
                found.append(last[at])
                at -= len(last[at])
            self.known[word] = np.array([i for p in reversed(found) for i in self._ids(p)], "<u4").tobytes()
            before = word

    # --- whole texts ------------------------------------------------------
    def words(self, text: str) -> list[str]:
        return self.word.findall(self.model.normalize(text))

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, without the mark that the normaliser put in front."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def plain(self, text: str | None) -> str:
        """The text as the normaliser leaves it, with spaces for marks."""
        text = self.model.normalize(text).replace(MARK, " ") if text else ""
        return text[1:] if text.startswith(" ") else text


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and model, while tasks use it."""
    return kept(PieceEncoder, path)


def _lists(codes: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    sizes = np.array([len(c) // 4 for c in codes], np.int64)
    flat = np.frombuffer(b"".join(codes), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)), sizes


def encode(texts: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_tokens, ids_crc32) of every whole text."""
    return _encode(texts, path, id_col, text_col, False)


def round_trip(texts: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode``, with ``same``: whether decoding the ids gives the normalised text back."""
    return _encode(texts, path, id_col, text_col, True)


def _encode(texts: DataFrame, path: str, id_col: str, text_col: str, back: bool) -> DataFrame:
    narrow = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            values = batch.column(1).to_pylist()
            codes = own.encode_all(values)
            lists, sizes = _lists(codes)
            out = {"id": (batch.column(0), None), "ids": (lists, None), "n_tokens": (sizes, pa.int64()), "ids_crc32": ([zlib.crc32(c) for c in codes], pa.int64())}
            if back:
                out["same"] = ([own.decode(np.frombuffer(c, "<u4")) == own.plain(t) for c, t in zip(codes, values)], pa.bool_())
            yield arrow_rows(out)

    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ids array<int>, n_tokens long, ids_crc32 long" + ", same boolean" * back
    return per_partition(narrow, work, schema).withColumnRenamed("id", id_col)


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every list of ids; null for null."""
    narrow = ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [None if x.as_py() is None else own.decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(1)]
            yield arrow_rows({"id": (batch.column(0), None), "text": (texts, pa.string())})

    kind = narrow.schema["id"].dataType.simpleString()
    return per_partition(narrow, work, f"id {kind}, text string").withColumnRenamed("id", id_col)
