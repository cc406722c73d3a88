"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece there is one last token. An automaton over the
vocabulary (token prefixes linked to their longest suffixes) lists the tokens
that end at each place; of these, the last token is the one whose left
neighbour, the last token of what precedes it, is compatible with it: merging
the two tokens' bytes by rank gives back just these two. Back-pointers from the
end emit the ids.

Texts are independent, so this is one pass without a shuffle; memory is a batch,
what a slice of it (its first text and 2 MB more) needs on the way, the
vocabulary and bounded tables of pieces and pairs per worker.

Defined cases: a null text is empty; an empty text has no ids and decodes to the
empty text; repeated rows give repeated results; a null doc_id is passed on;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces as P
from .common import map_arrow, table, texts

#: Pairs of tokens whose test is kept per worker; the share of pieces.CACHE_PIECES kept; bytes of text that are encoded at a time.
CACHE_PAIRS, CACHE_SHARE, SLICE_BYTES = 300_000, 0.5, 2 << 20


class PrefixBPE:
    """Encoder of single pieces for a vocabulary file with merges and an end-of-word suffix."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        letters = _byte_letters()
        #: A unit is one character: a byte's letter, or past 0x10000 a byte's letter that ends the word.
        self.plain = [letters[b] for b in range(256)]
        self.final = [chr(0x10000 + b) for b in range(256)]
        of_letter = {c: b for b, c in enumerate(self.plain)}
        units = {}
        for s, i in self.vocab.items():
            if self.suffix and s.endswith(self.suffix) and len(s) > len(self.suffix):
                s = s[: -len(self.suffix)]
                units[s[:-1] + self.final[of_letter[s[-1]]]] = i
            else:
                units[s] = i
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            pair = self.vocab[a], self.vocab[b]
            new = self.vocab[a + b]
            if new in self.parts:
                raise ValueError("two merges make one token: its last token would not be unique")
            self.rank[pair], self.parts[new], self.made[new] = rank, pair, rank
        self.automaton = ahocorasick.Automaton()
        for s, i in units.items():
            if len(s) == 1 or i in self.parts:
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        #: By left * n + right: one number takes less than a pair.
        self._fits: dict[int, bool] = {}
        self.n = max(self.vocab.values()) + 1

    def fits(self, left: int, right: int) -> bool:
        """Do two tokens stay as they are when their bytes are merged together?

        Undo the merges inside both tokens from the last made to the first; at
        each step, the parts that face each other across the border must not be
        a pair whose merge would have come before the merge undone last.
        """
        got = self._fits.get(left * self.n + right)
        if got is None:
            if len(self._fits) >= CACHE_PAIRS:
                self._fits.clear()
            got = self._fits[left * self.n + right] = self._test(left, right)
        return got

    def _test(self, a: int, b: int) -> bool:
        never = 1 << 60
        # merges of rank below `before` were done with a and b as they stand; one of rank `before` only if further left
        before, on_right = never, False
        while True:
            rank = self.rank.get((a, b))
            if rank is not None and (rank < before or (rank == before and on_right)):
                return False
            ra, rb = self.made.get(a, -1), self.made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # of equal ranks the left one was merged first, so the right one is undone first
            if rb >= ra:
                before, on_right, b = rb, True, self.parts[b][0]
            else:
                before, on_right, a = ra, False, self.parts[a][1]

    def units(self, piece: str) -> str:
        raw = piece.encode()
        return "".join([self.plain[b] for b in raw[:-1]]) + (self.final if self.suffix else self.plain)[raw[-1]]

    def encode_units(self, units: str) -> list[int]:
        n = len(units)
        last = [-1] * (n + 1)
        back = [0] * (n + 1)
        fits, known, many = self.fits, self._fits, self.n
        for end, (token, size) in self.automaton.iter(units):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = known.get(before * many + token)
                if not (fits(before, token) if ok is None else ok):
                    continue
            last[end], back[end] = token, start
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        out.reverse()
        return out

    def encode_piece(self, piece: str) -> list[int]:
        return self.encode_units(self.units(piece)) if piece else []


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b if b in printable else free))
        free += b not in printable
    return out


class Codec:
    """Whole texts to ids and back; one per worker and vocabulary."""

    def __init__(self, path: str):
        self.bpe = PrefixBPE(path)
        self.library = P.library(path)
        self.special, self.special_ids = P.specials(path)
        self.strings = self.bpe.strings | {i: s for s, i in self.special_ids.items()}
        letters = _byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.ids_of_piece: P.Bounded = P.Bounded()
        self.columns = PrefixEncoder(path, self)
        some = sorted(self.strings)
        if some != list(range(len(some))):
            raise ValueError("ids of the vocabulary are not 0, 1, 2, ...")
        self.numbers = pa.array(map(str, some), pa.large_string())
        self.names = pa.array([self.strings[i] for i in some], pa.large_string())

    def piece(self, piece: str) -> list[int]:
        got = self.ids_of_piece.get(piece)
        if got is None:
            got = self.bpe.encode_piece(piece)
            self.ids_of_piece.keep(piece, got)
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if P.is_plain(text, self.special):
            for word in text.lower().split():
                for piece in P.cut_word(word):
                    out += self.piece(piece)
            return out
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(self.special_ids[part])
            elif part:
                norm = self.library.normalizer.normalize_str(part)
                for units, _ in self.library.pre_tokenizer.pre_tokenize_str(norm):
                    if units:
                        raw = [self.byte_of[c] for c in units]
                        out += self.bpe.encode_units(units[:-1] + (self.bpe.final if self.bpe.suffix else self.bpe.plain)[raw[-1]])
        return out

    def decode(self, ids: list[int]) -> str:
        """What the vocabulary, which names no decoder, gives: its tokens joined by spaces."""
        return " ".join([self.strings[i] for i in ids])

    def joined(self, ids: np.ndarray, n: np.ndarray, strings: pa.Array) -> pa.Array:
        """The strings of the ids of each text, which has ``n`` of them, with blanks between."""
        bounds = pa.array(np.concatenate([[0], np.cumsum(n, dtype=np.int64)]))
        return pc.binary_join(pa.LargeListArray.from_arrays(bounds, strings.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))

    def digests(self, column: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, sha256 of the decimal ids and of the decoded text of each whole text of a string column."""
        n, of_ids, of_text = [], [], []
        for part in slices(column, SLICE_BYTES):
            ids, k = self.columns(part)
            n += k.tolist()
            # one kind of text after the other, hashed where it lies
            for out, strings in ((of_ids, self.numbers), (of_text, self.names)):
                out += [hashlib.sha256(x.as_buffer()).hexdigest() for x in self.joined(ids, k, strings)]
        return n, of_ids, of_text

    def forms(self, column: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Number of ids, decimal ids and decoded text of each whole text of a string column."""
        ids, n = self.columns(column)
        return n, self.joined(ids, n, self.numbers), self.joined(ids, n, self.names)


class PrefixEncoder(P.ColumnEncoder):
    """Ids by the dynamic programming; each new piece goes through it once."""

    def __init__(self, path: str, codec: Codec):
        super().__init__(path)
        self.bpe, self.whole = codec.bpe, codec.encode

    def most(self) -> int:
        return int(P.CACHE_PIECES * CACHE_SHARE)

    def learn(self, new: list[str]) -> None:
        known, encode = self.known, self.bpe.encode_piece
        for piece in new:
            known[piece] = array("i", encode(piece)).tobytes()


def slices(column: pa.Array, most: int) -> list[pa.Array]:
    """All of a string column in order; each slice has less than ``most`` bytes after its first text."""
    full = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), len(column)]
    return [column.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(documents: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """doc_id and the ids (array of int) of each whole text."""
    path = path or P.default_vocabulary()

    def run(batch):
        own = codec(path)
        return {"doc_id": batch.column(0), column: [own.encode(x) for x in batch.column(1).to_pylist()]}

    return map_arrow(texts(documents), run, f"doc_id long, {column} array<int>")


def decode(encoded: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """doc_id and the decoded text of each row's ids; null ids as none."""
    path = path or P.default_vocabulary()

    def run(batch):
        own = codec(path)
        return {"doc_id": batch.column(0), "text": [own.decode(x or []) for x in batch.column(1).to_pylist()]}

    return map_arrow(encoded.select("doc_id", F.col(column)), run, "doc_id long, text string")


def encode_decode_digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``documents``."""
    path = path or P.default_vocabulary()

    def run(batch):
        n, of_ids, of_text = codec(path).digests(batch.column(1))
        return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_text}

    return map_arrow(texts(documents), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(table(spark, sf_dir, "documents"))
