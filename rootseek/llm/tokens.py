"""Token ids of whole texts through the tokenizers library, one call per distinct chunk.

The vocabularies used here drop white space and never merge across it, and
their special strings hold none, so the ids of a text are those of its
white-space separated chunks, one after the other. A worker keeps the ids of
chunks it has met and calls the library only for new ones.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata

import numpy as np

from rootseek.llm.common import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words in one of a worker's two cache generations, at about 200 bytes each.
CACHE_WORDS = 600_000
#: Words looked up at once.
PIECE = 100_000
#: New words that are learned together.
LEARNED = 20_000
#: Words sent to the library in one string.
JOINED = 512
#: Characters that str.split takes for white space and the library does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Letters, single digits and runs of marks; a contraction begins with an apostrophe.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters before this one are Latin letters or marks, stand composed, and have one lower case everywhere.
LATIN = "\u0250"
SAFE_SPLIT = re.compile(r"[ \t\n\r\f\v]+")


def chunks(text: str) -> list[str]:
    """White-space separated chunks; never cuts where the library would not."""
    if any(c in text for c in SEPARATORS):
        return [c for c in SAFE_SPLIT.split(text) if c]
    return text.split()


def drops_white_space(path: str) -> bool:
    """Whether the vocabulary at ``path`` is of the kind this module relies on."""
    spec = json.load(open(path, encoding="utf-8"))
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    splits = [s for s in steps if s["type"] == "Split"]
    flags = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])]
    return bool(splits) and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and not flags


class WordCache:
    """Ids of words, as little-endian unsigned 32-bit integers, in bounded memory."""

    def __init__(self):
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        """Put the ids of ``new`` words, and of at most as many others, into ``known``."""
        raise NotImplementedError

    def take(self, new: set[str]) -> None:
        """Have the ids of all ``new`` words in ``known``.

        The cache has two generations: words met since the last turn, and those
        of the turn before, from which met ones move over.
        """
        if len(self.known) + 2 * len(new) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        for c in [c for c in new if c in self.older]:
            self.known[c] = self.older[c]
            new.discard(c)
        self.learn([c for c in new if c not in self.known])

    def lookup(self, parts: list[str]) -> list[bytes]:
        """The ids of each word, for at most ``PIECE`` words."""
        found = list(map(self.known.get, parts))
        if None in found:
            self.take({c for c, f in zip(parts, found) if f is None})
            found = [self.known[c] if f is None else f for c, f in zip(parts, found)]
        return found

    def words(self, text: str) -> list[str]:
        """The words of a whole text."""
        raise NotImplementedError

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """All ids of each whole text; empty for null."""
        out: list[list[bytes]] = [[] for _ in texts]
        open_, new = [], set()

        def settle():
            self.take(new)
            for i, at, parts, found in open_:
                out[i][at] = b"".join([self.known[c] if f is None else f for c, f in zip(parts, found)])
            open_.clear()
            new.clear()

        for i, text in enumerate(texts):
            words = self.words(text) if text else []
            for at in range(0, len(words), PIECE):
                parts = words[at : at + PIECE]
                found = list(map(self.known.get, parts))
                if None in found:
                    new.update(c for c, f in zip(parts, found) if f is None)
                    open_.append((i, len(out[i]), parts, found))
                    out[i].append(b"")
                else:
                    out[i].append(b"".join(found))
                if len(new) >= LEARNED:
                    settle()
        settle()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


class ChunkEncoder(WordCache):
    """White-space separated chunks through the tokenizers library.

    A chunk of letters with ASCII marks behind them is two pre-tokens at least, which the
    library may see apart: many stems of letters go in one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if not drops_white_space(path):
            raise ValueError(f"{path}: its pre-tokenizer keeps white space; encode whole texts instead")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        super().__init__()
        self.bare = lower_words(path, self.library.model)
        self.marks = string.punctuation if self.bare else ".,"

    def words(self, text: str) -> list[str]:
        return chunks(text)

    def _whole(self, items: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(items, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only: one pre-token each, so many fit into one call."""
        out: list[bytes] = []
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, e in zip(groups, self.library.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            owner = np.array(e.word_ids, dtype=np.float64)
            ids = np.array(e.ids, "<u4").tobytes()
            cuts = (4 * (np.flatnonzero(np.diff(owner)) + 1)).tolist()
            if len(cuts) + 1 == len(group) and not np.isnan(owner).any():
                out += [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)])]
            else:
                out += self._whole(group)
        return out

    def _lower(self, words: list[str]) -> list[bytes]:
        """Lower-case Latin words of letters only, without the library's normaliser."""
        out: list[bytes] = []
        library, last = self.bare
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, e in zip(groups, library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = (4 * (np.flatnonzero(last[ids]) + 1)).tolist()
            if len(cuts) == len(group) and cuts[-1] == 4 * len(ids):
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *cuts], cuts)]
            else:
                out += self._whole(group)
        return out

    def learn(self, new: list[str]) -> None:
        """Put the ids of ``new`` chunks into ``known``."""
        cut, rest = [], []
        lower, letters, tails = {}, {}, {}
        for c in new:
            stem = c.rstrip(self.marks)
            plain = stem if stem.isascii() else unicodedata.normalize("NFC", stem)
            low = plain.lower()
            if not low.isalpha():
                rest.append(c)
                continue
            tail = c[len(stem) :]
            if self.bare and (plain.isascii() or max(plain) < LATIN):
                lower[low] = None
                cut.append((c, low, tail))
            else:
                letters[stem] = None
                cut.append((c, stem, tail))
            tails[tail] = b""
        for encode, wanted in ((self._lower, lower), (self._letters, letters)):
            stems = [w for w in wanted if w not in self.known]
            self.known.update(zip(stems, encode(stems)))
        tails = dict(zip(tails, self._whole(list(tails))))
        for c, w, tail in cut:
            self.known[c] = self.known[w] + tails[tail] if tail else self.known[w]
        self.known.update(zip(rest, self._whole(rest)))


def lower_words(path: str, model) -> tuple | None:
    """(the library around ``model`` without its normaliser, which ids end a word) where lower-case Latin words come through that unchanged, and marks stand apart."""
    from tokenizers import Tokenizer, pre_tokenizers

    spec = json.load(open(path, encoding="utf-8"))
    steps, bytes_ = (spec.get("normalizer") or {}).get("normalizers", []), spec["pre_tokenizer"]["pretokenizers"][1:]
    suffix = spec["model"].get("end_of_word_suffix")
    if (
        [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]
        or (steps[1]["pattern"], steps[1]["content"]) != ({"Regex": r"\s+"}, " ")
        or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": WORD_PATTERN}
        or [(s["type"], s.get("add_prefix_space"), s.get("use_regex")) for s in bytes_] != [("ByteLevel", False, False)]
        or not suffix
    ):
        return None
    library = Tokenizer(model)
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    names = library.get_vocab()
    last = np.zeros(1 + max(names.values()), bool)
    last[[i for name, i in names.items() if name.endswith(suffix)]] = True
    return library, last


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary, while tasks use it."""
    return kept(ChunkEncoder, path)


def id_lists(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of each whole text, as little-endian unsigned 32-bit integers.

    White-space dropping vocabularies go by chunks; all others are given whole
    texts.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [np.array(model.encode(t or ""), "<u4").tobytes() for t in texts]
    try:
        by_chunk = encoder(path)
    except ValueError:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        return [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    return by_chunk.encode_all(texts)
