"""Locally consistent parsing of word sequences by recompression.

A round names maximal runs of a symbol, then pairs whose left symbol falls in the
left class and whose right symbol falls in the right class. Names are hashes of the
symbols they stand for, so they are global: any task gives equal content the same
name. A symbol's context is the stretch of words that decides that the symbol arises
there: its own words, and of each neighbour that was looked at, that neighbour's
context. Two places with equal words over a context hold the same symbol.

For every window of words, :func:`anchors` picks a symbol whose context lies in the
window, by a rule that looks at the window's own words only. Equal windows thus pick
equal symbols at equal places, wherever they stand; a window without such a symbol
stands for itself.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K

U64 = np.uint64
FAR = 1 << 40
#: Two rounds give symbols of up to four words (more in runs), whose contexts are about half a window of 20.
ROUNDS = 2
_NONE = U64(0xFFFFFFFFFFFFFFFF)
_RUN, _PAIR, _CLASS = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)


class Symbols:
    """Symbols in order: name, words [a, b), context [lo, hi), document."""

    __slots__ = ("name", "a", "b", "lo", "hi", "doc")

    def __init__(self, name, a, b, lo, hi, doc):
        self.name, self.a, self.b, self.lo, self.hi, self.doc = name, a, b, lo, hi, doc


def of_words(hashes: np.ndarray, doc: np.ndarray) -> Symbols:
    at = np.arange(len(hashes), dtype=np.int64)
    return Symbols(hashes, at, at + 1, at.copy(), at + 1, doc)


def name_runs(s: Symbols) -> Symbols:
    """Each maximal run of a symbol becomes one; a symbol's neighbours were looked at to see where its run ends."""
    n = len(s.name)
    if not n:
        return s
    same_doc = s.doc[1:] == s.doc[:-1]
    head = np.ones(n, bool)
    head[1:] = ~(same_doc & (s.name[1:] == s.name[:-1]))
    start = np.flatnonzero(head)
    stop = np.append(start[1:], n)
    length = stop - start
    name = s.name[start].copy()
    many = length > 1
    name[many] = K.mix(name[many] * _RUN ^ K.mix(length[many].astype(U64)))
    before = np.full(len(start), -FAR)
    before[1:] = np.where(same_doc[start[1:] - 1], s.lo[start[1:] - 1], -FAR)
    after = np.full(len(start), FAR)
    after[:-1] = np.where(same_doc[stop[:-1] - 1], s.hi[np.minimum(stop[:-1], n - 1)], FAR)
    lo = np.minimum(np.minimum(before, s.lo[start]), s.lo[stop - 1])
    hi = np.maximum(np.maximum(after, s.hi[stop - 1]), s.hi[start])
    return Symbols(name, s.a[start], s.b[stop - 1], lo, hi, s.doc[start])


def name_pairs(s: Symbols, level: int) -> Symbols:
    """Each pair of a left-class symbol and the right-class symbol after it becomes one; a symbol left alone looked at the neighbour it could have joined."""
    n = len(s.name)
    if n < 2:
        return s
    right = (K.mix(s.name ^ K.mix(np.array([level + 1], U64) * _CLASS)) & U64(1)).astype(bool)
    same_doc = s.doc[1:] == s.doc[:-1]
    joins = np.zeros(n, bool)
    joins[:-1] = same_doc & ~right[:-1] & right[1:]
    joined = np.zeros(n, bool)
    joined[1:] = joins[:-1]
    lo, hi = s.lo.copy(), s.hi.copy()
    name, b = s.name.copy(), s.b.copy()
    i = np.flatnonzero(joins)
    name[i] = K.mix(s.name[i] * _PAIR ^ K.mix(s.name[i + 1] + U64(level)))
    b[i] = s.b[i + 1]
    lo[i] = np.minimum(s.lo[i], s.lo[i + 1])
    hi[i] = np.maximum(s.hi[i], s.hi[i + 1])
    i = np.flatnonzero(~joins & ~joined & ~right)
    more = np.full(len(i), FAR)
    inner = i < n - 1
    inner[inner] = same_doc[i[inner]]
    k = i[inner]
    more[inner] = s.hi[k + 1]
    lo[k] = np.minimum(lo[k], s.lo[k + 1])
    hi[i] = np.maximum(hi[i], more)
    i = np.flatnonzero(~joined & right)
    less = np.full(len(i), -FAR)
    inner = i > 0
    inner[inner] = same_doc[i[inner] - 1]
    k = i[inner]
    less[inner] = s.lo[k - 1]
    hi[k] = np.maximum(hi[k], s.hi[k - 1])
    lo[i] = np.minimum(lo[i], less)
    keep = ~joined
    return Symbols(name[keep], s.a[keep], b[keep], lo[keep], hi[keep], s.doc[keep])


def levels(hashes: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The symbols after each round, the last first."""
    out, s = [], of_words(hashes, doc)
    for level in range(rounds):
        s = name_pairs(name_runs(s), level)
        out.append(s)
    return out[::-1]


def anchors(hashes: np.ndarray, doc: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the symbol picked by the window at each word; place is the first word of its context.

    Of the contexts in a window, those of the highest level are taken, of these the
    one whose key is smallest. The key hashes the symbol's name and the words of its
    context. A window without one has its own hash as key and its start as place.
    Windows that would leave their document have place -1.
    """
    n = len(hashes)
    n_windows = max(0, n - window + 1)
    blocks = K.Blocks(hashes)
    key = np.zeros(n, U64)
    place = np.full(n, -1, np.int64)
    open_ = np.zeros(n, bool)
    open_[:n_windows] = doc[window - 1 :] == doc[:n_windows] if n_windows else False
    for s in levels(hashes, doc, rounds):
        size = s.hi - s.lo
        fit = np.flatnonzero((size <= window) & (s.lo >= 0) & (s.hi <= n))
        if not len(fit) or not open_.any():
            continue
        lo, hi, size = s.lo[fit], s.hi[fit], size[fit]
        own = K.mix(s.name[fit] ^ blocks.slices(lo, hi))
        # contexts begin and end in the order of their symbols, so the first of those that begin at a word is the shortest: any window that holds another holds it
        first = np.ones(len(lo), bool)
        first[1:] = lo[1:] != lo[:-1]
        lo, size, own = lo[first], size[first], own[first]
        value = np.full(n + window, _NONE, U64)
        value[lo] = own
        length = np.full(n + window, window + 1, np.int32)
        length[lo] = size
        todo = np.flatnonzero(open_)
        best, at = np.full(len(todo), _NONE, U64), np.full(len(todo), -1, np.int64)
        for shift in range(window - int(size.min()) + 1):
            place_ = todo + shift
            seen = value[place_]
            better = (seen < best) & (length[place_] <= window - shift)
            best = np.where(better, seen, best)
            at = np.where(better, place_, at)
        hit = at >= 0
        key[todo[hit]], place[todo[hit]] = best[hit], at[hit]
        open_[todo[hit]] = False
    rest = np.flatnonzero(open_)
    key[rest] = blocks.slices(rest, rest + window)
    place[rest] = rest
    return key, place
