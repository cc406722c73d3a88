"""Removal of repeated passages, found by recompression.

A window is WINDOW consecutive words of a document. A word goes if a window that
covers it also starts earlier: in a document of smaller doc_id, or earlier in the same.

1. Rounds of recompression (see :mod:`recompression`) name runs and pairs of words
   globally; every window picks a symbol, and neighbouring windows that pick one
   occurrence make a stretch. Equal windows lie in stretches with the same key.
2. Stretches meet by key. Of stretches with equal names, all but the earliest are
   claimed as repeats. Where one key has different stretches, their earliest
   occurrences go on.
3. Only for those, the single windows meet by their names.
4. Neighbouring claims that are like neighbouring places of one document grow together
   to long repeats. Each is verified: a 256-bit digest of its words' bytes must be that
   of the place it is like. Should one fail, all stretches that met are compared window
   by window, sorted by their words' bytes.
5. Repeats become word ranges of their documents.

What crosses the network is about one row for six words, then rows of repeats. Equal
stretches meet inside a batch first, so a passage that a third of all documents hold
sends one row for each batch, and a sorted stream over each partition holds one row
as state. Names are hashes of words; they only propose.

Defined cases: a null or empty text has no words; a text shorter than a window loses
nothing; rows without doc_id come first; rows that share a doc_id are documents that
follow one another by text, and rows equal in both are one document whose result each
of them gets; an empty table gives no rows; other columns are ignored (the pipeline
stage keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import recompression as R
from .common import as_often, free, int64, map_arrow, materialise, partitions, settled, split_by_ids, stream_arrow, table, with_rows

WINDOW = 20
U64 = np.uint64
#: Most windows of a stretch, and what a row of _MET adds to their number where it is a claim already.
MOST_WINDOWS, _KNOWN = 31, 1 << 16
#: Of a known claim, ``tail`` is the row that it is like, and the upper half of ``key`` the place there.
_MET = "key long, tail long, row long, place int, n int"
#: kind: windows to compare singly, or a claimed repeat of what stands at the lead.
OPEN, CLAIM = 0, 1
_FOUND = "row long, place int, n int, kind int, lead_row long, lead_place int"
_RUNS = "row long, place int, n int, lead_row long, lead_place int"
_SPAN = "slot long, span binary, row long, place int, claim boolean"
_CHECKED = "row long, place int, n int, repeat boolean"


def _names(words: K.Words, bits: int) -> list[np.ndarray]:
    """Two names of each word; with few ``bits`` different words share names, which costs time, not results."""
    both = words.names()
    if bits < 64:
        both = K.mix(both & U64((1 << bits) - 1))
    return [np.ascontiguousarray(both[:, k]) for k in range(2)]


def _stretches(rows: np.ndarray, column: pa.Array, window: int, bits: int) -> dict[str, np.ndarray]:
    """Stretches of each text: row, place of the first window, number of windows, key and name of the words."""
    parts = []
    for first, _, buf, offsets in K.chunks(column):
        words = K.Words(buf, offsets)
        one, two = _names(words, bits)
        key, place = R.anchors(one, words.doc, window)
        own = np.flatnonzero(place >= 0)
        if not len(own):
            continue
        # windows of one document that pick one symbol follow one another
        head = np.ones(len(own), bool)
        head[1:] = (own[1:] != own[:-1] + 1) | (place[own[1:]] != place[own[:-1]]) | (key[own[1:]] != key[own[:-1]]) | (words.doc[own[1:]] != words.doc[own[:-1]])
        start = np.flatnonzero(head)
        # longer stretches become several, equal ones the same several
        since = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
        start = np.flatnonzero(since % MOST_WINDOWS == 0)
        n = np.diff(np.append(start, len(own)))
        a = own[start]
        doc = words.doc[a]
        parts.append((rows[first + doc], a - words.first[doc], n, key[a], K.Blocks(two).slices(a, a + n - 1 + window)))
    return _columns(parts)


def _columns(parts: list[tuple]) -> dict[str, np.ndarray]:
    if not parts:
        parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2]
    return dict(zip(("row", "place", "n", "key", "tail"), (np.concatenate(x) for x in zip(*parts))))


def _met(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of _MET for stretches of a batch; of equal ones only the earliest meets others, the rest are claims."""
    key, tail, n = s["key"].copy(), s["tail"].copy(), s["n"].astype(np.int64)
    again = np.flatnonzero(K.repeated(key))
    if len(again):
        order = again[np.lexsort((s["place"][again], s["row"][again], tail[again], key[again]))]
        head = np.ones(len(order), bool)
        head[1:] = (key[order][1:] != key[order][:-1]) | (tail[order][1:] != tail[order][:-1])
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))][~head]
        known = order[~head]
        # spread by their own place: they only pass through
        spread = K.mix(s["row"][known].astype(U64) ^ (s["place"][known].astype(U64) << U64(32))) & U64(0xFFFFFFFF)
        key[known] = (s["place"][lead].astype(U64) << U64(32)) | spread
        tail[known] = s["row"][lead].astype(np.int64).view(U64)
        n[known] |= _KNOWN
    return {"key": key.view(np.int64), "tail": tail.view(np.int64), "row": s["row"], "place": s["place"].astype(np.int32), "n": n.astype(np.int32)}


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Over rows of _MET in order: claims and what they are like, and the earliest occurrences of each stretch whose key has others."""
    key = tail = None  # of the last row
    lead = (0, 0)  # the earliest occurrence of that stretch
    held = None  # the only stretch of that key so far
    for batch in batches:
        cols = [int64(batch.column(i)) for i in range(5)]
        known = (cols[4] & _KNOWN) != 0
        cols[4] &= _KNOWN - 1
        out = [(*(c[known] for c in cols[2:]), np.full(int(known.sum()), CLAIM), cols[1][known], cols[0][known] >> 32)]
        k, t, r, p, n = (c[~known] for c in cols)
        if len(k):
            new_key, new = np.ones(len(k), bool), np.ones(len(k), bool)
            new_key[1:] = k[1:] != k[:-1]
            new[1:] = new_key[1:] | (t[1:] != t[:-1])
            if key is not None and k[0] == key:
                new_key[0], new[0] = False, t[0] != tail
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            lead_r, lead_p = np.where(at >= 0, r[at], lead[0]), np.where(at >= 0, p[at], lead[1])
            later = ~new & ((r != lead_r) | (p != lead_p))
            out.append((r[later], p[later], n[later], np.full(int(later.sum()), CLAIM), lead_r[later], lead_p[later]))
            # the first of each stretch, behind the one that waits
            f = np.flatnonzero(new)
            fk, fr, fp, fn = k[f], r[f], p[f], n[f]
            mixed_before = key is not None and not new_key[0] and held is None
            if held is not None:
                if new_key[0]:
                    held = None
                elif len(f):
                    fk, fr, fp, fn = (np.concatenate([[x], y]) for x, y in zip(held, (fk, fr, fp, fn)))
                    held = None
            if len(fk):
                heads = np.flatnonzero(np.append(True, fk[1:] != fk[:-1]))
                many = np.diff(np.append(heads, len(fk))) > 1
                if mixed_before and fk[0] == k[0]:
                    many[0] = True
                if not many[-1] and fk[-1] == k[-1]:
                    held = (fk[-1], fr[-1], fp[-1], fn[-1])
                go = np.repeat(many, np.diff(np.append(heads, len(fk))))
                none = np.full(int(go.sum()), -1)
                out.append((fr[go], fp[go], fn[go], np.full(int(go.sum()), OPEN), none, none))
            key, tail, lead = k[-1], t[-1], (int(lead_r[-1]), int(lead_p[-1]))
        columns = [np.concatenate(x) for x in zip(*out)]
        if len(columns[0]):
            yield {name: c if name.endswith("row") else c.astype(np.int32) for name, c in zip(("row", "place", "n", "kind", "lead_row", "lead_place"), columns)}


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False).astype(np.int64)


def _windows(column: pa.Array, rows: np.ndarray, ranges: pa.Array, window: int, bits: int) -> dict[str, np.ndarray]:
    """Rows of _MET for the single windows of some ranges (see :func:`_pack`) of each text."""
    bounds, packed = _packed(ranges)
    parts = []
    for first, stop, buf, offsets in K.chunks(column):
        words = K.Words(buf, offsets)
        one, two = _names(words, bits)
        own = packed[bounds[first] : bounds[stop]]
        doc = np.repeat(np.arange(stop - first), np.diff(bounds[first : stop + 1]))
        n = own & _COUNT
        which = np.repeat(np.arange(len(own)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        place = (own >> 32)[which] + step
        a = words.first[doc[which]] + place
        parts.append((rows[first + doc[which]], place, np.ones(len(a), np.int64), K.Blocks(one).slices(a, a + window), K.Blocks(two).slices(a, a + window)))
    return _columns(parts)


def _words_of(column: pa.Array, ranges: pa.Array, window: int, single: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(row of the batch, range, its words' number, lengths and bytes) for each range of each text, which is cut at the text's end; ``single``: of its first window alone."""
    bounds, packed = _packed(ranges)
    for first, stop, buf, offsets in K.chunks(column):
        words = K.Words(buf, offsets)
        data = buf[words.solid].tobytes()
        at = np.concatenate([[0], np.cumsum(words.end - words.start)]).tolist()
        lengths = (words.end - words.start).astype("<u4")
        for i in range(first, stop):
            base, end = int(words.first[i - first]), int(words.first[i - first + 1])
            for x in packed[bounds[i] : bounds[i + 1]].tolist():
                a = min(base + (x >> 32), end)
                b = min(a + (1 if single else x & _COUNT) - 1 + window, end)
                yield i, x, (b - a).to_bytes(4, "little") + lengths[a:b].tobytes() + data[at[a] : at[b]]


def _spans(rows: np.ndarray, column: pa.Array, ranges: pa.Array, window: int) -> dict[str, list]:
    """Rows of _SPAN: the words of single windows, whose number is 2 for a claim. A claim whose words stand earlier in the batch is settled here and passes without them."""
    entries = sorted(((int(rows[i]), x >> 32, (x & _COUNT) == 2, words) for i, x, words in _words_of(column, ranges, window, True)), key=lambda e: e[:2])
    seen: dict[bytes, tuple[int, int]] = {}
    slot, span = [], []
    for row, place, claim, words_ in entries:
        known = claim and seen.setdefault(words_, (row, place)) != (row, place)
        slot.append(hash((row, place)) if known else int.from_bytes(hashlib.blake2b(words_, digest_size=8).digest(), "little", signed=True))
        span.append(None if known else words_)
    return {"slot": slot, "span": span} | {k: [e[j] for e in entries] for j, k in enumerate(("row", "place", "claim"))}


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Over rows of _SPAN in order of their words, then place: whether each claim's words stand earlier."""
    before: bytes | None = None
    first = (0, 0)
    for batch in batches:
        out = []
        for span, row, place, claim in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            if span is not None and span != before:
                before, first = span, (row, place)
            if claim:
                out.append((row, place, span is None or (row, place) != first))
        if out:
            row, place, repeat = zip(*out)
            yield {"row": list(row), "place": list(place), "n": [1] * len(out), "repeat": list(repeat)}


def _runs(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Rows of _RUNS: claims of each document (row, list of place, n, lead_row, lead_place) that continue one another grown together."""
    claims = batch.column(1)
    ends = claims.offsets.to_numpy().astype(np.int64)
    flat = claims.values
    place, n, lead_row, lead_place = (int64(flat.field(k))[ends[0] : ends[-1]] for k in range(4))
    row = np.repeat(int64(batch.column(0)), np.diff(ends))
    order = np.lexsort((place, row))
    row, place, n, lead_row, lead_place = (x[order] for x in (row, place, n, lead_row, lead_place))
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + n[:-1]) | (lead_row[1:] != lead_row[:-1]) | (lead_place[1:] != lead_place[:-1] + n[:-1])
    start = np.flatnonzero(head)
    total = np.add.reduceat(n, start) if len(start) else n
    return {"row": row[start], "lead_row": lead_row[start]} | {k: x.astype(np.int32) for k, x in (("place", place[start]), ("n", total), ("lead_place", lead_place[start]))}


def _sorted_meeting(met: DataFrame) -> DataFrame:
    dealt = met.repartition(partitions(met.sparkSession), "key").sortWithinPartitions("key", "tail", "row", "place")
    return stream_arrow(dealt, _meet, _FOUND)


_COUNT = (1 << 32) - 1


def _pack(place: str = "place", n: str = "n"):
    """A range as one number: place of its first window times 2**32, plus its number of windows."""
    return F.shiftleft(F.col(place).cast("long"), 32) + F.col(n)


def _ranges(found: DataFrame) -> DataFrame:
    """One row for each document: its ranges, packed."""
    return found.groupBy("row").agg(F.collect_list(_pack()).alias("ranges"))


def _texts_with(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """row, text, ranges of the documents that have any. ``ranges`` was written before."""
    some, _ = split_by_ids(rows.select("row", "text"), ranges)
    return some.join(ranges, "row").select("row", "text", "ranges")


def _single(rows: DataFrame, found: DataFrame, window: int, bits: int) -> DataFrame:
    """Claims among the single windows of ``found`` (row, place, n)."""
    open_ = materialise(_ranges(found), "repeats-open")

    def single(batch):
        return _met(_windows(batch.column(1), int64(batch.column(0)), batch.column(2), window, bits))

    return _sorted_meeting(map_arrow(_texts_with(rows, open_), single, _MET)).filter(F.col("kind") == CLAIM)


def _confirmed(rows: DataFrame, claims: DataFrame, window: int) -> DataFrame:
    """row, place, n of each long repeat, and whether the place that it is like has the same words."""
    listed = claims.groupBy("row").agg(F.collect_list(F.struct("place", "n", "lead_row", "lead_place")).alias("claims"))
    runs = materialise(map_arrow(listed, _runs, _RUNS), "repeats-runs")
    asked = runs.select("row", _pack().alias("span")).unionByName(runs.select(F.col("lead_row").alias("row"), _pack("lead_place").alias("span"))).distinct()
    asked = materialise(asked.groupBy("row").agg(F.collect_list("span").alias("ranges")), "repeats-asked")

    def digest(batch):
        got = [(i, x, hashlib.blake2b(words, digest_size=32).digest()) for i, x, words in _words_of(batch.column(1), batch.column(2), window)]
        return {"row": int64(batch.column(0))[[i for i, _, _ in got]], "span": [x for _, x, _ in got], "words": [d for _, _, d in got]}

    spans = materialise(map_arrow(_texts_with(rows, asked), digest, "row long, span long, words binary"), "repeats-spans")
    own = runs.select("row", "place", "n", _pack().alias("span"), "lead_row", _pack("lead_place").alias("lead_span"))
    like = spans.select(F.col("row").alias("lead_row"), F.col("span").alias("lead_span"), F.col("words").alias("lead_words"))
    both = own.join(spans, ["row", "span"]).join(like, ["lead_row", "lead_span"])
    return materialise(both.select("row", "place", "n", (F.col("words") == F.col("lead_words")).alias("repeat")), "repeats-checked")


def _sorted_by_words(rows: DataFrame, claims: DataFrame, window: int) -> DataFrame:
    """row, place, n of each claimed single window, and whether its words stand earlier, whatever it was claimed to be like."""
    claimed = claims.select("row", "place", F.lit(2).alias("n"))
    leads = claims.select(F.col("lead_row").alias("row"), F.col("lead_place").alias("place"), F.lit(1).alias("n")).distinct()
    wanted = materialise(_ranges(claimed.unionByName(leads)), "repeats-claimed")

    def spans(batch):
        return _spans(int64(batch.column(0)), batch.column(1), batch.column(2), window)

    met = map_arrow(_texts_with(rows, wanted), spans, _SPAN)
    dealt = met.repartition(partitions(rows.sparkSession), "slot").sortWithinPartitions("slot", "span", "row", "place")
    return materialise(stream_arrow(dealt, _check, _CHECKED), "repeats-sorted")


def repeats(rows: DataFrame, window: int = WINDOW, bits: int = 64) -> DataFrame:
    """row and ranges (see :func:`_pack`) of the windows that also start earlier. ``rows``: row, text; ``bits``: of the words' names."""
    if not 2 <= window <= 1024:
        raise ValueError(f"window must be 2 to 1024 words, not {window}")
    return settled("repeats", lambda: _ranges(_repeated(rows, window, bits)))


def _repeated(rows: DataFrame, window: int, bits: int) -> DataFrame:
    """row, place, n of what :func:`repeats` finds."""

    def parse(batch):
        return _met(_stretches(int64(batch.column(0)), batch.column(1), window, bits))

    found = materialise(_sorted_meeting(map_arrow(rows.select("row", "text"), parse, _MET)), "repeats-found")
    claims = found.filter(F.col("kind") == CLAIM)
    checked = _confirmed(rows, claims.unionByName(_single(rows, found.filter(F.col("kind") == OPEN), window, bits)), window)
    if not checked.filter(~F.col("repeat")).isEmpty():
        # different words shared a name: all that met is compared window by window
        leads = claims.select(F.col("lead_row").alias("row"), F.col("lead_place").alias("place"), "n")
        everything = found.select("row", "place", "n").unionByName(leads).distinct()
        checked = _sorted_by_words(rows, _single(rows, everything, window, bits), window)
    return checked.filter("repeat")


def _kept(n_words: int, packed: np.ndarray, window: int) -> np.ndarray:
    start, n = packed >> 32, packed & _COUNT
    return ~K.covered(n_words, start, n - 1 + window)


def _without(batch, window: int) -> dict:
    """n_words, n_removed and the kept words of each text; the batch has text and ranges third and fourth."""
    n, gone, kept_words = [], [], []
    ranges = batch.column(3)
    bounds, packed = ranges.offsets.to_numpy(), ranges.values.to_numpy(zero_copy_only=False).astype(np.int64)
    for i, raw in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
        words = raw.split()
        a, b = bounds[i], bounds[i + 1]
        n.append(len(words))
        if b > a:
            keep = _kept(len(words), packed[a:b], window)
            words = [words[j] for j in np.flatnonzero(keep).tolist()]
        gone.append(n[-1] - len(words))
        kept_words.append(b" ".join(words))
    return {"n_words": n, "n_removed": gone, "kept": kept_words}


def removal(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``documents`` (doc_id, text)."""
    rows, plain = with_rows(documents)
    found = repeats(rows, window)
    changed, same = split_by_ids(rows, found)
    empty = F.array().cast("array<long>")
    parts = [changed.join(found, "row", "left").withColumn("ranges", F.coalesce("ranges", empty))]
    if same is not None:
        parts.append(same.withColumn("ranges", empty))

    def run(batch):
        got = _without(batch, window)
        sha = [hashlib.sha256(x).hexdigest() for x in got.pop("kept")]
        return got | {"doc_id": batch.column(0), "kept_sha256": sha, "copies": batch.column(1)}

    def apply(df: DataFrame) -> DataFrame:
        return map_arrow(df.select("doc_id", "copies", "text", "ranges"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string, copies int")

    out = apply(parts[0])
    for more in parts[1:]:
        out = out.unionByName(apply(more))
    return out.drop("copies") if plain else as_often(out)


def repeated_spans(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, first_word, n_words of each maximal stretch of words that :func:`removal` takes out."""
    rows, plain = with_rows(documents)
    spans = repeats(rows, window).withColumn("r", F.explode("ranges"))
    spans = spans.select("row", F.shiftright("r", 32).alias("a"), (F.shiftright("r", 32) + F.col("r").bitwiseAND(F.lit(_COUNT)) - 1 + window).alias("b"))

    def merge(pdf):
        pdf = pdf.sort_values("a")
        high = pdf["b"].cummax()
        group = (pdf["a"] > high.shift(fill_value=-1)).cumsum()
        got = pdf.assign(g=group).groupby("g").agg(a=("a", "min"), b=("b", "max"))
        return got.assign(row=pdf["row"].iloc[0])[["row", "a", "b"]]

    merged = spans.groupBy("row").applyInPandas(merge, "row long, a long, b long")
    out = merged.join(rows.select("row", "doc_id", "copies"), "row").select("doc_id", F.col("a").alias("first_word"), (F.col("b") - F.col("a")).alias("n_words"), "copies")
    return out.drop("copies") if plain else as_often(out)


def strip_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` with all their columns, the repeated words taken out of text (n_chars follows); texts without any stay as they are."""
    rows, _ = with_rows(documents)
    found = settled("stripped", lambda: repeats(rows, window).join(rows.select("row", "doc_id", "text"), "row"))
    id_, hash_, new_ = free(documents, "id_changed", "hash_changed", "text_changed")

    def run(batch):
        import re

        out = []
        ranges = batch.column(3)
        bounds, packed = ranges.offsets.to_numpy(), ranges.values.to_numpy(zero_copy_only=False).astype(np.int64)
        for i, raw in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
            keep = np.flatnonzero(_kept(len(places), packed[bounds[i] : bounds[i + 1]], window))
            cuts = np.split(keep, np.flatnonzero(np.diff(keep) > 1) + 1) if len(keep) else []
            out.append(b" ".join(raw[places[c[0]][0] : places[c[-1]][1]] for c in cuts).decode())
        return {id_: batch.column(0), hash_: batch.column(1), new_: out}

    new = map_arrow(found.select("doc_id", F.xxhash64("text"), "text", "ranges"), run, f"{id_} long, {hash_} long, {new_} string")
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = documents.join(new, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(hash_)), "left")
    changed = {"text": F.coalesce(new_, "text")}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col(new_).isNotNull(), F.char_length(new_).cast(kind)).otherwise(F.col("n_chars"))
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in documents.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents"))


#: DuckDB SQL for :func:`query`'s rows.
ORACLE = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from d),
codes as (select word, row_number() over () as code from (select distinct word from w)),
g as (select doc_id, p, {", ".join(f"lead(code, {k}) over (partition by doc_id order by p) as c{k}" for k in range(WINDOW))} from w join codes using (word)),
windows as (select doc_id, p, row_number() over (partition by {", ".join(f"c{k}" for k in range(WINDOW))} order by doc_id, p) as place from g where c{WINDOW - 1} is not null),
gone as (select distinct doc_id, unnest(range(p, p + {WINDOW})) as p from windows where place > 1),
kept as (
  select w.doc_id, string_agg(w.word, ' ' order by w.p) as words, count(*) as k
  from w left join gone on gone.doc_id = w.doc_id and gone.p = w.p where gone.p is null group by w.doc_id
)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(kept.k, 0) as bigint) as n_removed, sha256(coalesce(kept.words, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id
"""
