"""Vectorised text kernels over the byte buffers of Arrow string columns.

A batch is one ``uint8`` buffer with document offsets; words are runs of bytes
outside space and 0x09-0x0D. Words are equal where their keys are: the bytes of a
word of up to 15, a 120-bit BLAKE2b of a longer one. Names that hold across batches
are hashes of keys. Only long words are visited in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 512 << 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 5 modulo 8, so that its powers differ in their low bits.
_B1 = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    own = _powers.get(base)
    if own is None or len(own) < n:
        own = np.ones(max(1024, 1 << (n - 1).bit_length()), U64)
        size = 1
        while size < len(own):
            own[size : 2 * size] = own[:size] * U64(pow(base, size, 1 << 64))
            size *= 2
        _powers[base] = own
    return own[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Rolling:
    """Rolling hashes of the windows of a sequence of 64-bit values: a filter, whose hits are compared value by value (see :func:`repeats_of`)."""

    def __init__(self, values: np.ndarray, base: int = _B1):
        n = len(values)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.undo = powers(pow(base, -1, 1 << 64), n + 1)

    def windows(self, n: int) -> np.ndarray:
        """Hash of every window of n neighbours, by its start."""
        k = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:k]) * self.undo[:k]) if k > 0 else np.zeros(0, U64)


_LEFT, _RIGHT = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One value for two in order. Mixed on both sides, so that no sum of products makes different sequences equal."""
    return mix(mix(a * _LEFT + U64(1)) ^ (b * _RIGHT))


class Blocks:
    """Names of slices of a sequence of 64-bit names, from names of its blocks of 1, 2, 4, ... neighbours.

    Slices of one length are equal if the two blocks that cover them are; each
    block's name pairs those of its halves, as a hash tree does.
    """

    def __init__(self, values: np.ndarray):
        self.levels = [values]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(pair(last[:-half], last[half:]) if len(last) > half else np.zeros(0, U64))
        return self.levels[k]

    def windows(self, n: int) -> np.ndarray:
        """Name of every window of n neighbours, by its start."""
        k, m = n.bit_length() - 1, len(self.levels[0]) - n + 1
        if m <= 0:
            return np.zeros(0, U64)
        own = self.level(k)
        return pair(own[:m] + U64(n), own[n - (1 << k) : n - (1 << k) + m])

    def slices(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Names of the slices [a, b), none of them empty."""
        out = np.zeros(len(a), U64)
        n = b - a
        level = np.frexp(n.astype(float))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            own = self.level(k)
            out[at] = pair(own[a[at]] + n[at].astype(U64), own[b[at] - (1 << k)])
        return out


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Byte strings that follow one another in ``data``."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


#: Bytes of a word that its key holds as they are.
SHORT = 15
_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(SHORT + 1)], U64)
_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(SHORT + 1)], U64)
_ROUNDS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5))


def named(keys: np.ndarray) -> np.ndarray:
    """Two 64-bit names (columns) for keys of two 64-bit halves: four rounds of a Feistel network, and the key added again so that it cannot be run backwards."""
    low, high = keys[:, 0], keys[:, 1]
    a, b = low, high
    for constant in _ROUNDS:
        a, b = b, a ^ mix(b + constant)
    return np.column_stack([a ^ low, b ^ high])


class Words:
    """Words of consecutive documents in one buffer: start, end (bytes), doc, first (word index of each document, one more at the end)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets, self.n_docs = buf, offsets, len(offsets) - 1
        space = _SPACE[buf]
        solid = ~space
        head, tail = solid.copy(), solid.copy()
        if len(buf):
            head[1:] &= space[:-1]
            tail[:-1] &= space[1:]
            at = offsets[offsets < len(buf)]
            head[at] = solid[at]
            at = offsets[offsets > 0] - 1
            tail[at] = solid[at]
        self.solid = solid
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def keys(self, lower: bool = False) -> np.ndarray:
        """Two 64-bit halves (columns) of each word's key: equal keys are equal words.

        Up to SHORT bytes the key holds the word's bytes and their number; of a longer
        word, its 120-bit BLAKE2b.
        """
        n = self.end - self.start
        out = np.zeros((len(n), 2), U64)
        if not len(n):
            return out
        data = np.concatenate([_LOWER[self.buf] if lower else self.buf, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        some = np.minimum(n, SHORT)
        out[:, 0] = eight[self.start] & _LOW[some]
        out[:, 1] = (eight[self.start + 8] & _HIGH[some]) | (some.astype(U64) << U64(56))
        long = np.flatnonzero(n > SHORT)
        if len(long):
            raw = data.tobytes()
            seen: dict[bytes, bytes] = {}
            parts = []
            for a, b in zip(self.start[long].tolist(), self.end[long].tolist()):
                word = raw[a:b]
                digest = seen.get(word)
                if digest is None:
                    digest = seen[word] = blake2b(word, digest_size=SHORT).digest() + b"\xff"
                parts.append(digest)
            out[long] = np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)
        return out

    def names(self, lower: bool = False) -> np.ndarray:
        """Two 64-bit names (columns) of each word, the same wherever the word stands."""
        return named(self.keys(lower))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """The first of the two names."""
        return np.ascontiguousarray(self.names(lower)[:, 0])


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, next row, buffer, offsets) for slices of a string column of about ``size`` bytes; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, stop, whole[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def within(words: Words, n: int) -> np.ndarray:
    """For each window of n words by start: does it stay in its document."""
    d = words.doc
    return d[n - 1 :] == d[: len(d) - n + 1] if len(d) >= n else np.zeros(0, bool)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur more than once."""
    out = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return out
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        # a table of their low bits spares most keys the search
        bits = np.array(0xFFFF, keys.dtype)
        there = np.zeros(1 << 16, bool)
        there[twice & bits] = True
        some = np.flatnonzero(there[keys & bits])
        at = np.searchsorted(twice, keys[some])
        at[at == len(twice)] = 0
        out[some] = twice[at] == keys[some]
    return out


def repeats_of(keys: np.ndarray, words: Words, n: int, rolled: Rolling) -> np.ndarray:
    """Starts of the windows of n words that occur more than once in their document.

    Rolling hashes propose, the words' keys decide: neighbours in the order of
    hashes are compared word by word, and if any differ, all proposed windows are.
    """
    inside = np.flatnonzero(within(words, n))
    hashes = rolled.windows(n)[inside] ^ mix(words.doc[inside].astype(U64) + U64(1))
    hit = repeated(hashes)
    starts, hashes = inside[hit], hashes[hit]
    if not len(starts):
        return starts
    order = np.argsort(hashes, kind="stable")
    at, hashes = starts[order], hashes[order]
    twin = hashes[1:] == hashes[:-1]
    a, b = at[:-1][twin], at[1:][twin]
    equal = words.doc[a] == words.doc[b]
    for k in range(n):
        equal &= (keys[a + k] == keys[b + k]).all(1)
    if equal.all():
        return starts
    rows = np.column_stack([words.doc[starts].astype(U64), *(keys[starts + k] for k in range(n))])
    _, which, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    return starts[count[which.reshape(-1)] > 1]


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Mask of n places inside any [start, start+length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
