"""Licence rules against a plain matcher, look-alikes, and time on long texts."""

import random
import re
import time

import pytest

from chromaflow.llm import licenses

LOOK_ALIKES = (
    "we run our servers on freebsd and postgresql", "the ruby license office", "vim license plate", "neither the name of the rose", "library general public license version 2 1",
    "an apache helicopter flew over mit", "the boost came from zlib", "eclipse public viewing", "a python ate the isc member", "openssl heartbleed was a bug", "a driving license", "php 3 was old",
    "the general public was here", "creative commons room", "license to kill", "under the sea", "mozilla firefox 2 0", "unlicensed driver",
)

LABELLED = {
    "Released under the Apache License, Version 2.0": "apache-2",
    "licensed under the GNU General Public License, version 3": "gpl-3.0",
    "licensed under the GNU General Public License version 2 or later": "gpl-2.0",
    "GNU Library General Public License version 2.1": "lgpl-2.1",
    "GNU Library General Public License version 2 only": "lgpl-2.0",
    "published under the ISC license": "isc",
    "SPDX-License-Identifier: BSD-2-Clause": "bsd-2-clause",
    "This work is in the public domain.": "public-domain",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
    "available under a CC BY-NC-SA 4.0 licence": "cc-by-nc,cc-by-nc-sa",
}


def plain(text):
    """The contract's words, all rules tried, containment against all matches kept."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    normal = " " + " ".join(w.decode("latin-1") for w in words) + " "
    found = [(m.start(), m.end(), r) for r in licenses.rules() for m in r.pattern.finditer(normal)]
    found.sort(key=lambda x: (x[2].priority, x[0] - x[1], x[0], -x[2].confidence))
    kept = []
    for a, b, rule in found:
        if not any(x <= a and b <= y for x, y, _ in kept):
            kept.append((a, b, rule))
    starts, base = [], set()
    for phrase, label in licenses.BASE:
        p = [x.encode() for x in phrase.split()]
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    doubt = 0.02 if base else 1.0
    for _, _, rule in kept:
        doubt *= 1 - rule.confidence
    labels = base | {r.label for _, _, r in kept}
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), pytest.approx(min(1, max(0, 1 - doubt)))


def samples():
    rng = random.Random(10)
    pieces = [*LOOK_ALIKES, *LABELLED, "x", "Ünder the MIT license", "under the MIT License", "cc by nc", "cc-by-nc-nd 4.0", "all rights reserved", "gpl v2", "\x00", "é", "GNU Affero General Public License v3.0"]
    return ["", " ", *pieces, *(rng.choice([" ", "\n", ", "]).join(rng.choices(pieces, k=rng.randint(2, 12))) for _ in range(150))]


def test_scan_is_that_of_a_plain_matcher():
    for text in samples():
        assert licenses.scan(text.encode()) == plain(text.encode()), text


def test_rules_and_keywords():
    rules = licenses.rules()
    assert len({r.pattern.pattern for r in rules}) == len(rules) > 300
    assert [r.priority for r in rules] == sorted(r.priority for r in rules)
    for rule in rules:
        assert min(len(k) for k in rule.keywords) >= 3, rule
    assert licenses.keywords("a(?:bc|de)f+ghi j?") == ("ghi ",)
    assert set(licenses.keywords("x(?:longer|other)y")) == {"longer", "other"}


def test_look_alikes_have_no_label():
    for text in LOOK_ALIKES:
        assert licenses.scan(text.encode())[5] == "", text
    for text, labels in LABELLED.items():
        assert licenses.scan(text.encode())[5] == labels, text


def test_long_texts_take_time_in_proportion():
    text = b"licensed under the gnu general public license version 3 all rights reserved under the mit license cc by nc " * 40_000
    began = time.perf_counter()
    n, places, first, last, *_ = licenses.scan(text)
    assert (n, places, first, last) == (19 * 40_000, 2 * 40_000, 12, 19 * 40_000 - 3) and time.perf_counter() - began < 30


def test_query_rows(spark):
    texts = samples()[:60] + [None]
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, labels string").repartition(3)
    for r in licenses.license_scan(frame).collect():
        assert tuple(r)[1:] == plain((texts[r.doc_id] or "").encode())
    for r in licenses.license_spans(frame).collect():
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in texts[r.doc_id].encode())
        words = [w.decode() for w in re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)]
        assert " ".join(words[r.first_word : r.first_word + r.n_words]) == r.matched
