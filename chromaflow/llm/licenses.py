"""Licence scan by ordered signature rules.

A text becomes its words (ASCII letters lower-cased, digits, other characters) with
single spaces. Several hundred hand-written regular expressions (see
:mod:`license_rules`) are gated by keywords: one automaton over all rules' keywords
reads the text once, and only rules whose keyword occurs are tried. Matches are taken
in order of priority, then length, then place; one that lies within a match taken
before it is suppressed. Base phrases are exact word sequences and are always reported.

One pass without a shuffle; memory is one batch. Whole texts are scanned, in time that
grows with their length and, with its logarithm, with the number of matches.

Defined cases: a null text is empty: no words, no labels (empty strings), score 0,
null places; repeated rows give repeated results; a null doc_id is passed on; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table, texts
from .license_rules import IDENTIFIERS, RULES

#: Fixed values of the query's contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Words that say little of a rule when its keyword is chosen.
_PLAIN = frozenset("under the terms of is a may be not this and or to in you copy software".split())

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    name: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int
    confidence: float


def _weight(literal: str) -> int:
    return sum(len(w) for w in literal.split() if w not in _PLAIN)


def keywords(expression: str) -> tuple[str, ...]:
    """Strings of which each match of ``expression`` holds one: the weightiest run of plain characters, or one of each alternative."""
    from re import _constants as C
    from re import _parser as parser

    def best(sequence) -> tuple[str, ...]:
        found: list[tuple[str, ...]] = []
        run = ""
        for op, value in [*sequence, (None, None)]:
            if op is C.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append((run,))
                run = ""
            if op is C.SUBPATTERN:
                found.append(best(value[3]))
            elif op is C.BRANCH:
                each = [best(x) for x in value[1]]
                found.append(tuple(k for x in each for k in x) if all(each) else ())
            elif op is C.MAX_REPEAT and value[0] > 0:
                found.append(best(value[2]))
        found = [x for x in found if x]
        return max(found, key=lambda x: min(_weight(k) for k in x)) if found else ()

    return best(parser.parse(expression))


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All signature rules, in order of priority."""
    out = []
    for line in IDENTIFIERS.split("\n"):
        if line:
            identifier, label = line.split()
            words = re.sub("[^a-z0-9]+", " ", identifier.lower())
            # the longer identifier is another rule's: BSD-2-Clause-Patent is not BSD-2-Clause
            out.append((label, "identifier", f"spdx license identifier {words}(?: only| or later| plus)?", 0, 1.0))
    section, priority = "", 0
    for line in RULES.split("\n"):
        if line.startswith("["):
            section, priority = line.strip("[]"), priority + 1
        elif line:
            label, confidence, expression = (x.strip() for x in line.split(" | "))
            out.append((label, section, expression, priority, float(confidence)))
    made = []
    for label, name, expression, priority, confidence in out:
        made.append(Rule(label, name, re.compile(f" (?:{expression})(?= )"), keywords(expression), priority, confidence))
    return tuple(made)


@lru_cache(1)
def _automaton():
    """Finds every keyword in one reading; its values are the places of the rules it opens."""
    from ahocorasick import Automaton

    opens: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        for k in rule.keywords:
            opens.setdefault(k, []).append(i)
    own = Automaton()
    for k, which in opens.items():
        own.add_word(k, tuple(which))
    own.make_automaton()
    return own


class _Cover:
    """Intervals taken so far: does one contain [a, b]? A tree of prefix maxima over the starts known beforehand."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.most = [-1] * (len(self.starts) + 1)

    def contains(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        while i:
            if self.most[i] >= b:
                return True
            i &= i - 1
        return False

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a) + 1
        while i < len(self.most):
            self.most[i] = max(self.most[i], b)
            i += i & -i


def detections(normal: str) -> list[tuple[int, int, Rule]]:
    """Matches (start, end, rule) in `` words joined and enclosed by spaces `` that no match before them in order contains."""
    opened: set[tuple[int, ...]] = {which for _, which in _automaton().iter(normal)}
    if not opened:
        return []
    own = rules()
    found = []
    for i in sorted({i for which in opened for i in which}):
        found += [(m.start(), m.end(), own[i]) for m in own[i].pattern.finditer(normal)]
    found.sort(key=lambda x: (x[2].priority, x[0] - x[1], x[0], -x[2].confidence))
    taken, kept = _Cover([a for a, _, _ in found]), []
    for a, b, rule in found:
        if not taken.contains(a, b):
            taken.add(a, b)
            kept.append((a, b, rule))
    return kept


def normalised(text: bytes) -> tuple[str, int]:
    """(words joined and enclosed by spaces, their number); bytes beyond ASCII are one character each."""
    words = text.translate(_NORMAL).split()
    return (b" " + b" ".join(words) + b" ").decode("latin-1"), len(words)


def _spaces(normal: str) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a whole text."""
    normal, n_words = normalised(text)
    places, base = [], set()
    for phrase, label in BASE:
        needle = f" {phrase} "
        at = normal.find(needle)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = normal.find(needle, at + 1)
    first = last = None
    if places:
        first, last = np.searchsorted(_spaces(normal), [min(places), max(places)]).tolist()
    kept = detections(normal)
    doubt = 0.02 if base else 1.0
    for _, _, rule in kept:
        doubt *= 1 - rule.confidence
    labels = base | {rule.label for _, _, rule in kept}
    score = min(1.0, max(0.0, 1 - doubt))
    return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(documents: DataFrame) -> DataFrame:
    """FIELDS of every row of ``documents`` (doc_id, text)."""

    def run(batch):
        import pyarrow as pa

        got = [scan(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        return {"doc_id": batch.column(0)} | {k: [x[i] for x in got] for i, k in enumerate(FIELDS)}

    return map_arrow(texts(documents), run, SCHEMA)


def license_spans(documents: DataFrame) -> DataFrame:
    """One row per surviving detection: doc_id, label, rule, first_word, n_words, matched text, confidence."""

    def run(batch):
        import pyarrow as pa

        out: list[tuple] = []
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            normal, _ = normalised(raw)
            kept = detections(normal)
            if not kept:
                continue
            first = np.searchsorted(_spaces(normal), [a for a, _, _ in kept]).tolist()
            for (a, b, rule), place in zip(kept, first):
                span = normal[a:b].strip()
                out.append((i, rule.label, rule.name, place, span.count(" ") + 1, span.encode("latin-1").decode(), rule.confidence))
        names = ("doc_id", "label", "rule", "first_word", "n_words", "matched", "confidence")
        return {k: [x[j] for x in out] for j, k in enumerate(names)}

    return map_arrow(texts(documents), run, "doc_id long, label string, rule string, first_word long, n_words long, matched string, confidence double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
