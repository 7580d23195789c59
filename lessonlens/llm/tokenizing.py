"""Token ids by the vocabulary files of public tokenizers, with the ids of words kept per worker.

The tokenizer of words lowers case, drops white space and merges inside words only, so the ids of a text are those of its
white-space-separated pieces one after the other. Each distinct piece is given to the library once while it is kept; the
store is emptied at ``STORE`` pieces and holds short pieces only, so memory is bounded.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

STORE = 500_000
LONGEST = 64
#: the white space of the tokenizer's pattern that str.split does not cut at, or the other way round
ODD = re.compile("[\x1c-\x1f]")
ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
WHITE = re.compile("[^\\S\x1c-\x1f]+")


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary(name: str) -> str:
    """Where the installed package has a vocabulary file; each worker asks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Words(dict):
    """Byte-level form of a word -> its ids; the library's model does the merging."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        found = self.model.tokenize(word)
        ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        if len(word) <= LONGEST:
            if len(self) >= STORE:
                self.clear()
            self[word] = ids
        return ids


class Pieces(dict):
    """A piece between white space -> its ids. Printable ASCII is cut here, all else by the library."""

    def __init__(self, tokenizer):
        super().__init__()
        self.words = Words(tokenizer.model)
        self.normal, self.cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            parts = ASCII_WORDS.findall(piece.lower())
        else:
            parts = [word for word, _ in self.cut(self.normal(piece))]
        ids = b"".join([self.words[w] for w in parts])
        if len(piece) <= LONGEST:
            if len(self) >= STORE:
                self.clear()
            self[piece] = ids
        return ids


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes, for the tokenizer that works inside words."""

    kept: dict[str, "WordIds"] = {}

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.pieces = Pieces(self.tokenizer)

    @classmethod
    def of(cls, path: str) -> "WordIds":
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, text: str) -> bytes:
        # a special string stands for itself only whole; texts with one are left to the library
        if self.special.search(text):
            return self.direct([text])[0]
        pieces = WHITE.split(text) if ODD.search(text) else text.split()
        return b"".join(map(self.pieces.__getitem__, pieces))
