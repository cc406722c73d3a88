"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, computed in numpy over a batch's byte
buffer, find the n-grams that occur twice or more in a document; coverage is the
share of the document's characters inside such n-grams, or inside repeated
lines. Hashes only propose: n-grams and lines count as equal where their words'
and lines' bytes are. All state is one batch; nothing is shuffled.

Defined cases: a null text is empty; an empty text has no words and fails the
base rule; rows are judged one by one, so repeated rows and a null doc_id get
the same result each time; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .common import map_arrow, table, texts

BASE_LENGTH = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Most of a document's characters (percent) that may lie in duplicated n-grams of a length, or in duplicated lines.
NGRAM_LIMITS = {4: 60, 6: 40, 8: 30, 12: 25}
LINE_LIMIT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_WIDE = ", ".join(f"chars_in_repeated_{n}grams long" for n in NGRAM_LIMITS)
MEASURES = f"n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_in_repeated_lines long, {_WIDE}"
RESULT = f"doc_id long, {MEASURES}, base_failed boolean, kept boolean"


def measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each document of a chunk."""
    words = K.Words(buf, offsets)
    keys = words.keys()
    lead = (buf & 0xC0) != 0x80
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead & words.solid, out=points[1:])
    size = points[words.end] - points[words.start]
    n_words = np.diff(words.first)
    out = {
        "n_words": n_words,
        "word_chars": points[offsets[1:]] - points[offsets[:-1]],
        "n_symbols": K.per_doc(_SYMBOL[buf], offsets),
    }
    out |= line_repeats(buf, offsets, points)

    rolled = K.Rolling(np.ascontiguousarray(K.named(keys)[:, 0]))
    for n in sorted({BASE_LENGTH, *NGRAM_LIMITS}):
        hit = K.covered(len(keys), K.repeats_of(keys, words, n, rolled), n)
        if n == BASE_LENGTH:
            out["n_repeat_words"] = K.per_doc(hit, words.first)
        if n in NGRAM_LIMITS:
            out[f"chars_in_repeated_{n}grams"] = K.per_doc(np.where(hit, size, 0), words.first)
    return out


def line_repeats(buf: np.ndarray, offsets: np.ndarray, points: np.ndarray) -> dict[str, np.ndarray]:
    """Lines with a word that equal an earlier line of their document, and the characters of words in lines that occur twice or more."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    start = start[start < len(buf)]
    if not len(start):
        return {"n_dup_lines": np.zeros(n, np.int64), "chars_in_repeated_lines": np.zeros(n, np.int64)}
    doc = np.searchsorted(offsets, start, "right") - 1
    at = np.searchsorted(breaks, start)
    stop = np.minimum(np.append(breaks, len(buf))[at], offsets[doc + 1])
    line = K.binaries(buf[buf != 10], stop - start).dictionary_encode().indices.to_numpy().astype(np.int64)
    chars = points[stop] - points[start]
    some = np.flatnonzero(chars > 0)
    key, doc, chars = doc[some] * (len(start) + 1) + line[some], doc[some], chars[some]
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    both = K.repeated(key)
    return {
        "n_dup_lines": np.bincount(doc[later], minlength=n).astype(np.int64),
        "chars_in_repeated_lines": np.bincount(doc[both], weights=chars[both], minlength=n).astype(np.int64),
    }


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)"""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    bad = 100 * m["chars_in_repeated_lines"] > LINE_LIMIT * m["word_chars"]
    for n, most in NGRAM_LIMITS.items():
        bad |= 100 * m[f"chars_in_repeated_{n}grams"] > most * m["word_chars"]
    return failed, ~failed & ~bad


def repetition_rules(documents: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row of ``documents`` (doc_id, text)."""

    def run(batch):
        parts = [measure(buf, offsets) for _, _, buf, offsets in K.chunks(batch.column(1))]
        m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        failed, kept = verdict(m)
        return m | {"doc_id": batch.column(0), "base_failed": failed, "kept": kept}

    return map_arrow(texts(documents), run, RESULT)


def quality_filter(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with all their columns.

    Rows that share a doc_id, or have none, are each judged by their own text.
    """

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                column = batch.column(batch.schema.get_field_index("text"))
                kept = np.concatenate([verdict(measure(buf, offsets))[1] for _, _, buf, offsets in K.chunks(column)])
                yield batch.filter(pa.array(kept))

    from .common import small_batches

    small_batches(documents.sparkSession)
    return documents.mapInArrow(judge, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """DuckDB SQL for :func:`query`'s rows."""
    grams = ",\n".join(
        f"""starts{n} as (select i, p from (select i, p, count(*) over (partition by i, {"".join(f"c{k}, " for k in range(n)).rstrip(", ")}) as k from g where c{n - 1} is not null) where k > 1),
hit{n} as (select i, sum(size) as chars, count(*) as words from (select distinct s.i, s.p + o.k as p from starts{n} s, range({n}) o(k)) join c using (i, p) group by i)"""
        for n in sorted({BASE_LENGTH, *NGRAM_LIMITS})
    )
    ahead = ", ".join(f"lead(code, {k}) over (partition by i order by p) as c{k}" for k in range(max(NGRAM_LIMITS)))
    joins = " ".join(f"left join hit{n} using (i)" for n in sorted({BASE_LENGTH, *NGRAM_LIMITS}))
    wide = ", ".join(f"cast(coalesce(hit{n}.chars, 0) as bigint) as chars_in_repeated_{n}grams" for n in NGRAM_LIMITS)
    bad = " or ".join([f"100 * chars_in_repeated_{n}grams > {most} * word_chars" for n, most in NGRAM_LIMITS.items()] + [f"100 * chars_in_repeated_lines > {LINE_LIMIT} * word_chars"])
    return f"""
with t as (select row_number() over () as i, doc_id, coalesce(text, '') as text from documents),
d as (select i, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws from t),
w as (select i, unnest(ws) as word, generate_subscripts(ws, 1) as p from d),
codes as (select word, row_number() over () as code from (select distinct word from w)),
c as (select i, p, code, length(word) as size from w join codes using (word)),
g as materialized (select i, p, {ahead} from c),
{grams},
lines as (
  select i, line, sum(length(w)) as chars, count(*) as k from (
    select i, line, place, unnest(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as w from (
      select i, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place from d
    )
  ) group by i, line, place
),
line_sums as (select i, sum(k - 1) as again, sum(case when k > 1 then chars else 0 end) as chars from (select i, line, count(*) as k, sum(chars) as chars from lines group by i, line) group by i),
m as (
  select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(line_sums.again, 0) as bigint) as n_dup_lines,
    cast(coalesce(hit{BASE_LENGTH}.words, 0) as bigint) as n_repeat_words, cast(coalesce(line_sums.chars, 0) as bigint) as chars_in_repeated_lines, {wide}
  from d left join line_sums using (i) {joins}
),
v as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m)
select *, not base_failed and not ({bad}) as kept from v
"""


ORACLE = _oracle()
