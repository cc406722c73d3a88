"""What both tokenizing operators share: cutting a text into the pieces that a word-level BPE encodes one by one.

The vocabulary normalises (NFC, white space, lower case) and cuts at white
space, so a text's ids are those of its white-space words in order. For texts of
characters on which Python and the library certainly agree, the cut is done
here and every word is looked up once per worker; any other text goes through
the library's own normaliser and cutter as a whole. Nothing is approximated.
"""

from __future__ import annotations

import gc
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: ASCII and Latin letters without those whose lower case, class or composition is special; white space is ASCII only.
_SAFE = re.compile("[\\t-\\r\\x20-\\x7e\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-įı-ňŊ-ž]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: The same, for Arrow's engine: of the characters of plain texts, its letters and digits are Python's.
_PIECE_ARROW = r"'s|'t|'re|'ve|'m|'ll|'d|\pL+|[0-9]|[^\pL0-9\s]+"
#: Pieces kept per worker, and the longest piece worth keeping.
CACHE_PIECES, CACHE_LENGTH = 600_000, 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(2)
def library(path: str):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


@lru_cache(2)
def specials(path: str) -> tuple[re.Pattern, dict[str, int]]:
    ids = {t.content: k for k, t in library(path).get_added_tokens_decoder().items()}
    return re.compile("(" + "|".join(re.escape(x) for x in sorted(ids, key=len, reverse=True)) + ")"), ids


def is_plain(text: str, special: re.Pattern) -> bool:
    return _SAFE.fullmatch(text) is not None and not ("<|" in text and special.search(text))


def cut_word(word: str) -> list[str]:
    """The pieces of a lower-case white-space word of a plain text."""
    return _PIECE.findall(word)


def cut_words(words: pa.Array) -> pa.ListArray:
    """The pieces, in lower case, of each of some white-space words of plain texts."""
    apart = pc.replace_substring_regex(pc.utf8_lower(words), _PIECE_ARROW, r"\0 ")
    return pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(apart))


class ColumnEncoder:
    """Ids of whole texts. Of plain texts, the words of a batch are cut once each, column by column, and each new piece is encoded once.

    ``learn`` and ``whole`` say how: the ids of pieces, and of a text that is not plain.
    """

    def __init__(self, path: str):
        self.library = library(path)
        self.special, _ = specials(path)
        #: Little-endian 32-bit ids of each piece.
        self.known: dict[str, bytes] = {"": b""}

    def most(self) -> int:
        """Pieces that are kept."""
        return CACHE_PIECES

    def learn(self, new: list[str]) -> None:
        """Puts the ids of pieces not seen before into ``known``."""
        raise NotImplementedError

    def whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a string column in order, number of ids of each)"""
        texts = column.to_pylist()
        plain = [is_plain(x, self.special) for x in texts]
        odd = [i for i, p in enumerate(plain) if not p]
        split = pc.ascii_split_whitespace(pa.array([x if p else "" for x, p in zip(texts, plain)], pa.string()) if odd else column)
        words = split.flatten().dictionary_encode()
        got = self.forms(words.dictionary).take(words.indices)
        ids = got.flatten().to_numpy()
        bounds = _offsets(got)[_offsets(split)]
        counts = np.diff(bounds)
        if odd:
            parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            for i in odd:
                parts[i] = np.array(self.whole(texts[i]), np.int32)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts

    def forms(self, words: pa.Array) -> pa.ListArray:
        """The ids of each word of plain texts."""
        cut = cut_words(words)
        pieces = cut.flatten().dictionary_encode()
        got = self.ids(pieces.dictionary.to_pylist()).take(pieces.indices)
        return pa.ListArray.from_arrays(pa.array(_offsets(got)[_offsets(cut)], pa.int32()), got.flatten())

    def ids(self, pieces: list[str]) -> pa.ListArray:
        """The ids of each of some distinct pieces."""
        # pieces and ids hold no cycles; without a pause the collector walks the growing table again and again
        gc.disable()
        try:
            new = [p for p in pieces if p not in self.known]
            if len(self.known) + len(new) > self.most():
                self.known = {"": b""} | {p: self.known[p] for p in pieces if p in self.known}
            self.learn(new)
            out = [self.known[p] for p in pieces]
            for p in new:
                if len(p) > CACHE_LENGTH:
                    del self.known[p]
        finally:
            gc.enable()
        bounds = np.zeros(len(out) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, out), np.int32, len(out)) // 4, out=bounds[1:])
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(out), "<i4")))


def _offsets(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in what flatten() gives, and the end of the last."""
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0]


class Bounded(dict):
    """A cache that starts over when it is full."""

    def keep(self, key, value) -> None:
        if len(key) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[key] = value
