"""N-gram Jaccard self-join of documents by a grouped prefix join.

A document's set holds its distinct shingles of SHINGLE words (ASCII letters
lower-cased); two documents link where the Jaccard similarity is MATCH percent or
more. Result: one row per document with its component.

1. Words are counted over all documents. Shingles are ordered by the count of their
   rarest word, then by the product of counts, then by hash: one global order, under
   which a frequent shingle is in a prefix only if nearly all of a document is frequent.
   Words below a cut of TABLE_WORDS words count as rare alike; this table is broadcast.
2. Equal sets become one class. Classes with equal prefix and size become one group.
3. Groups meet by the shingles of their prefixes, which are so much longer that linked
   sets share several (:func:`shared_needed`). Shingles of more than BUCKET groups
   are found by a partial aggregation first. The others make pairs, which pass if
   sizes, positions and the number of shared prefix shingles allow a link. Only a group
   with that many frequent shingles can have links that share no other. Its members meet
   by parts of their sets: a hash deals a set over more parts than linked sets can differ
   in, so linked sets agree in some. Parts of more than BUCKET members, as in copies,
   form a chain of size bands, made by aggregations: no task sees all groups of a shingle.
4. What hangs together by pairs and chains is an island; no link leaves its island.
   Groups expand to their members, whose whole sets are compared inside the island:
   in one task if it is small, else in pairs of blocks. By the triangle inequality of
   the Jaccard distance, a member linked with one compared before is passed over where
   no set outside is near enough, so that copies cost one comparison each. A task gives
   a spanning forest of the verified links, not all of them.
5. Components of the verified links, then of the classes.

Scale: prefixes (a tenth of the shingles) cross the network once, parts of sets (about as
many as two prefixes) only of groups with several frequent shingles; texts only of
documents in islands and of those groups. Buckets stream in order with a bounded window; an island's
blocks are bounded by MOST_BLOCK. All-pairs work is quadratic only in the members of one
island that are neither copies of each other nor told apart by their shingles or parts.

Words and shingles are equal by 64 bits derived from a 128-bit BLAKE2b of each word's
bytes, equal sets by 128 bits of both halves: a link needs nine tenths of two sets.

Defined cases: null and empty texts, and texts without words, have the empty set and
link with nothing; with fewer words than a shingle the whole sequence is the one
shingle; rows that share a doc_id are documents of their own with that id, rows
without one count in no component_id but their own (null); an empty table gives no
rows; other columns are ignored (the pipeline stage keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import as_often, few_broadcast, free, int64, map_arrow, materialise, partitions, settled, split_by_ids, stream_arrow, table, with_rows
from .components import components

SHINGLE, MATCH = 3, 90
TABLE_WORDS = 250_000
BUCKET = 32
#: Prefixes are one shingle longer, and one more for so many shingles of a set.
SPARE = 100
#: Sets that differ in so many shingles at most are dealt over few parts, which meet in pairs.
FEW = 8
BLOCK, MOST_BLOCK, MOST_COPIES = 128, 8192, 8
U64 = np.uint64


class Rarity:
    """Counts of the frequent words: sorted hashes and a level (two for each doubling); other words have level 0."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.levels = (1 + np.floor(2 * np.log2(np.maximum(counts[order], 1)))).astype(np.int64)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(words), np.int64)
        at = np.searchsorted(self.hashes, words)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == words, self.levels[at], 0)


def word_rarity(rows: DataFrame, most: int = TABLE_WORDS) -> Rarity:
    """The most frequent words of all texts, ``most`` at most, with their counts over all texts."""

    def count(batch):
        found = [K.Words(buf, offsets).hashes(lower=True) for _, _, buf, offsets in K.chunks(batch.column(0))]
        word, n = np.unique(np.concatenate(found), return_counts=True)
        return {"word": word.view(np.int64), "n": n}

    counts = map_arrow(rows.select("text"), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "word-counts")
    level = F.floor(F.log2("n") * 4)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    total, cut = 0, None
    for size in sizes:
        total += size["words"]
        if total > most:
            break
        cut = size["level"]
    if cut is None:
        return Rarity(np.zeros(0, U64), np.zeros(0, np.int64))
    listed = counts.filter(level >= cut).toPandas()
    return Rarity(listed["word"].to_numpy(np.int64).view(U64), listed["n"].to_numpy(np.int64))


def prefix_length(n, match: int = MATCH):
    """Of two sets that match, with n shingles or fewer, the first so many of any common order share one."""
    return n - -(-match * n // 100) + 1


def shared_needed(n: int, match: int = MATCH) -> int:
    """So many shingles are shared by the prefixes of matching sets that are longer by one less; for two sets, the smaller number of theirs."""
    return min(2 + n // SPARE, -(-match * n // 100))


def overlap_needed(a, b, match: int = MATCH):
    """Fewest common shingles of matching sets of these sizes."""
    return -(-match * (a + b) // (100 + match))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word names, two names (columns) of each shingle by its first word, first words, numbers of shingles with repeats) for chunks of texts."""
    for first, _, buf, offsets in K.chunks(column):
        words = K.Words(buf, offsets)
        names = words.names(lower=True)
        n = np.diff(words.first)
        short = np.flatnonzero((n > 0) & (n < size))
        a = words.first[short]
        shingles = np.zeros((len(names), 2), U64)
        for half in range(2):
            blocks = K.Blocks(np.ascontiguousarray(names[:, half]))
            full = blocks.windows(size)
            shingles[: len(full), half] = full
            shingles[a, half] = blocks.slices(a, a + n[short])
        yield first, names[:, 0], shingles, words.first[:-1], np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))


def _sets(rows: DataFrame, rarity, match: int, size: int) -> DataFrame:
    """row, n (shingles), two halves of a digest of the set, digest of the prefix, the prefix (longer: see :func:`shared_needed`)."""

    def run(batch):
        level_of = rarity.value
        row = int64(batch.column(0))
        n_all = np.zeros(len(row), np.int64)
        one, two, three = (np.zeros(len(row), np.int64) for _ in range(3))
        prefixes: list[np.ndarray] = []
        for first, words, shingles, starts, counts in shingle_sets(batch.column(1), size):
            level = level_of(words)
            low, total = level.copy(), level.copy()
            for k in range(1, size):
                low[:-k] = np.minimum(low[:-k], level[k:])
                total[:-k] += level[k:]
            order = low * 4096 + total
            for i, (a, c) in enumerate(zip(starts.tolist(), counts.tolist())):
                own = shingles[a : a + c]
                got, at = np.unique(own[:, 0], return_index=True)
                n = len(got)
                p = prefix_length(n, match) - 1 + shared_needed(n, match) if n else 0
                rank = np.lexsort((got, order[a : a + c][at]))[:p] if n else at
                prefix = got[rank].view(np.int64)
                digest = hashlib.blake2b(own[at].tobytes(), digest_size=16).digest()
                k = first + i
                n_all[k] = n
                one[k], two[k] = np.frombuffer(digest, np.int64)
                three[k] = np.frombuffer(hashlib.blake2b(prefix.tobytes(), digest_size=8).digest(), np.int64)[0]
                prefixes.append(prefix)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
        return {"row": row, "n": n_all, "one": one, "two": two, "three": three, "prefix": lists}

    return map_arrow(rows.select("row", "text"), run, "row long, n long, one long, two long, three long, prefix array<long>")


_EDGE = "a long, b long, na long, nb long"


def _bucket_pairs(match: int, bucket: int):
    """Over (token, n, id, pos) in order, no token more than ``bucket`` times: pairs within the bounds of size and position."""

    def pairs(t, n, g, p):
        out = []
        for step in range(1, min(bucket, len(t))):
            a, b = slice(None, -step), slice(step, None)
            alike = t[a] == t[b]
            if not alike.any():
                break
            near = np.flatnonzero(alike & (100 * n[a] >= match * n[b]) & (g[a] != g[b]))
            na, nb, pa_, pb = n[a][near], n[b][near], p[a][near], p[b][near]
            most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
            near = near[most >= overlap_needed(na, nb, match)]
            out.append((g[a][near], g[b][near], n[a][near], n[b][near]))
        return out

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 4
        for batch in _then_end(batches):
            cols = rest if batch is None else [np.concatenate([r, int64(batch.column(i))]) for i, r in enumerate(rest)]
            t = cols[0]
            if not len(t):
                continue
            stop = len(t) if batch is None else int(np.searchsorted(t, t[-1]))
            rest = [c[stop:] for c in cols]
            found = pairs(*(c[:stop] for c in cols))
            if found:
                a, b, x, y = (np.concatenate(c) for c in zip(*found))
                if len(a):
                    yield {"a": np.minimum(a, b), "b": np.maximum(a, b), "na": np.where(a < b, x, y), "nb": np.where(a < b, y, x)}

    return run


def _then_end(batches):
    yield from batches
    yield None


def _split(tokens: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose token is listed, the others). ``listed`` was written before."""
    some, other = split_by_ids(tokens, listed, "token")
    if other is not None:
        return some, other
    return tokens.join(listed, "token", "left_semi"), tokens.join(listed, "token", "left_anti")


def _frequent(tokens: DataFrame, bucket: int) -> DataFrame:
    """The tokens of more than ``bucket`` groups: counted by partial aggregation, so that no task sees all rows of one."""
    return materialise(tokens.groupBy("token").agg(F.count("*").alias("k")).filter(F.col("k") > bucket).select("token"), "frequent-tokens")


def _pairs(tokens: DataFrame, match: int, bucket: int) -> DataFrame:
    dealt = tokens.repartition(partitions(tokens.sparkSession), "token").sortWithinPartitions("token", "n", "id")
    return stream_arrow(dealt.select("token", "n", "id", "pos"), _bucket_pairs(match, bucket), _EDGE)


def _chains(tokens: DataFrame, match: int) -> DataFrame:
    """Edges (a, b) that connect all groups of a token whose sizes may match: by aggregation, a group to the first of its size band, a band to the next."""
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / match)) + 1e-9).cast("long")
    banded = tokens.select("token", "id", band.alias("band"))
    firsts = materialise(banded.groupBy("token", "band").agg(F.min("id").alias("first")), "chain-bands")
    inside = banded.join(firsts, ["token", "band"]).select(F.col("first").alias("a"), F.col("id").alias("b")).filter("a <> b").distinct()
    after = firsts.select("token", (F.col("band") - 1).alias("band"), F.col("first").alias("b"))
    return inside.unionByName(firsts.join(after, ["token", "band"]).select(F.col("first").alias("a"), "b").distinct())


def _least(n: Column, match: int) -> Column:
    """Fewest shingles of a set that matches one of ``n``; equal to match percent, rounded up."""
    return F.ceil(F.lit(match) * n / 100.0 - 1e-9)


def _shared(n: Column, match: int) -> Column:
    """:func:`shared_needed` of a column."""
    return F.least(F.floor(n / float(SPARE)) + 2, _least(n, match))


def size_bands(n: int, match: int) -> list[tuple[int, int]]:
    """The bands of sizes that a set of ``n`` shares with matching ones, by the first size of the smaller set's band; and in how many shingles such sets differ at most."""
    low, found = 1, []
    while low <= n:
        after = 100 * low // match + 1
        if 100 * (after - 1) // match >= n:  # the smaller set has low to after - 1 shingles, its match at most so many
            found.append((low, (after - 1 + 100 * (after - 1) // match) * (100 - match) // (100 + match)))
        low = after
    return found


def parts_of_set(own: np.ndarray, low: int, most: int) -> tuple[np.ndarray, int]:
    """Names of parts of a set (distinct shingle names), and how many of them a set that differs in at most ``most`` shingles has too.

    Each shingle falls into one of most + agree parts, so that agree parts at least are
    equal. Few parts are joined in pairs, which are seldom empty. Of many, empty ones count
    only where agree or more are empty: if both sets are so, they share them, else another.
    """
    agree = 2 if most <= FEW else 2 + most // 6
    n = most + agree
    place = ((K.mix(own) >> U64(32)) % U64(n)).astype(np.int64)
    content = np.zeros(n, U64)
    np.add.at(content, place, K.mix(own ^ U64(0x9E3779B97F4A7C15)))
    content = K.mix(content + K.mix(np.arange(n, dtype=U64) + (U64(low) << U64(32))))
    if most <= FEW:
        i, j = np.triu_indices(n, 1)
        return K.mix(content[i] + K.mix(content[j])), 1
    full = np.bincount(place, minlength=n) > 0
    empty = n - int(full.sum())
    return (content[full], agree - empty) if empty < agree else (content, 1)


_PART = "token long, n long, id long, pos long, row long, low long, least long"


def _parts(match: int, size: int):
    """Rows of _PART of each (id, row, text): the parts of its set for each band of sizes."""

    def run(batch):
        ids, rows = int64(batch.column(0)), int64(batch.column(1))
        names, numbers, which = [np.zeros(0, U64)], [], []
        for first, _, shingles, starts, counts in shingle_sets(batch.column(2), size):
            for i, (a, c) in enumerate(zip(starts.tolist(), counts.tolist())):
                own = np.unique(shingles[a : a + c, 0])
                for low, most in size_bands(len(own), match):
                    if most:  # else only equal sets match
                        got, least = parts_of_set(own, low, most)
                        names.append(got)
                        numbers.append((len(own), low, least))
                        which += [first + i]
        each = [len(x) for x in names[1:]]
        n, low, least = (np.repeat(np.array([x[k] for x in numbers], np.int64), each) for k in range(3))
        at = np.repeat(np.array(which, np.int64), each)
        return {"token": np.concatenate(names).view(np.int64), "n": n, "id": ids[at], "pos": np.zeros(len(at), np.int64), "row": rows[at], "low": low, "least": least}

    return run


def candidate_edges(groups: DataFrame, match: int = MATCH, bucket: int | None = None, members: DataFrame | None = None, rows: DataFrame | None = None, size: int = SHINGLE) -> DataFrame:
    """a, b: pairs of groups that may hold linked members, and chains through frequent tokens. ``groups``: id, n, prefix; ``members``: row, id of different sets; ``rows``: row, text.

    Two sets that match share :func:`shared_needed` tokens of their prefixes. A token of
    at most ``bucket`` groups makes pairs, filtered by size, position and number of shared
    tokens. Where too few tokens of a group are frequent, its matches share another one.
    Members of the other groups meet by parts of their sets; a part of more than
    ``bucket`` members makes chains, of those with so many such parts that a match may
    share no other. Without ``members``, groups make chains through their frequent tokens.
    """
    bucket = BUCKET if bucket is None else bucket
    tokens = groups.select("id", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "n", "id", F.col("pos").cast("long").alias("pos"))
    frequent = _frequent(tokens, bucket)
    often, rare = _split(tokens, frequent)
    pairs = materialise(_pairs(rare, match, bucket), "bucket-pairs").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    # what two sets share beyond the common part of their prefixes is at most the longer rest; of frequent tokens, those that meet here alone share few
    need = F.ceil(F.lit(match) * (F.col("na") + F.col("nb")) / F.lit(100.0 + match) - 1e-9)
    rest = F.greatest(*[_least(F.col(c), match) - _shared(F.col(c), match) for c in ("na", "nb")])
    few = F.greatest(*[_shared(_least(F.col(c), match), match) - 1 for c in ("na", "nb")])
    edges = pairs.filter(F.col("shared") + rest + few >= need).select("a", "b")
    if frequent.isEmpty():
        return edges

    many = often.groupBy("id", "n").agg(F.count("*").alias("k")).filter(F.col("k") >= _shared(_least(F.col("n"), match), match))
    many = materialise(many.select("id"), "frequent-groups")
    if members is None:
        return edges.unionByName(_chains(often.join(many, "id", "left_semi"), match)).distinct()
    asked = materialise(members.join(many, "id").select("row", "id"), "frequent-members")
    some, _ = split_by_ids(rows.select("row", "text"), asked)
    parts = materialise(map_arrow(some.join(asked, "row").select("id", "row", "text"), _parts(match, size), _PART), "set-parts")
    common, single = _split(parts, _frequent(parts, bucket))
    met = _pairs(single.select("token", "n", "id", "pos"), match, bucket).select("a", "b").distinct()
    copied = common.groupBy("row", "low").agg(F.count("*").alias("k"), F.first("least").alias("least")).filter("k >= least").select("row", "low")
    copied = common.join(materialise(copied, "copied-rows"), ["row", "low"], "left_semi")
    return edges.unionByName(met).unionByName(_chains(copied, match)).distinct()


def _forest(match: int, size: int):
    """Over (task, row, text) in order of task: a spanning forest of the links in each task."""

    def links(rows: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        n = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), n)
        by_token = np.argsort(ids, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(ids))])
        owners = owner[by_token]
        starts = np.concatenate([[0], np.cumsum(n)])
        parent = list(range(len(sets)))
        settled = np.zeros(len(sets), bool)
        far = 1 - match / 100

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x in range(len(sets)):
            if settled[x]:
                continue
            own = ids[starts[x] : starts[x + 1]]
            a, b = bounds[own], bounds[own + 1]
            length = b - a
            where = np.repeat(a - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
            common = np.bincount(owners[where], minlength=len(sets))
            either = n[x] + n - common
            hit = 100 * common >= match * either
            for y in np.flatnonzero(hit).tolist():
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    out.append((int(rows[x]), int(rows[y])))
            # Jaccard distance is a metric: what links with a set y linked here is at most its distance + far away from x.
            # Where all so near are linked with x themselves, y brings nothing new.
            distance = 1 - common / either
            nearest = distance[~hit].min(initial=2.0)
            settled |= hit & (distance + far + 1e-9 < nearest)
        return out

    def run(batches):
        task, rows, sets = None, [], []
        for batch in _then_end(batches):
            found: list[tuple[int, int]] = []
            if batch is None:
                entries = [((None, None, None), 0, None)]
            else:
                texts_sets: list[np.ndarray] = []
                for _, _, shingles, starts, counts in shingle_sets(batch.column(4), size):
                    texts_sets += [np.unique(shingles[a : a + c, 0]) for a, c in zip(starts.tolist(), counts.tolist())]
                keys = list(zip(*(int64(batch.column(i)).tolist() for i in range(3))))
                entries = zip(keys, int64(batch.column(3)).tolist(), texts_sets)
            for key, row, own in entries:
                if key != task:
                    if len(sets) > 1:
                        found += links(np.array(rows), sets)
                    task, rows, sets = key, [], []
                rows.append(row)
                sets.append(own)
            if found:
                yield {"a": [x for x, _ in found], "b": [y for _, y in found]}

    return run


def verified_links(members: DataFrame, rows: DataFrame, match: int = MATCH, size: int = SHINGLE) -> DataFrame:
    """a, b: links that connect whatever is linked inside an island. ``members``: row, island; ``rows``: row, text."""
    spark = members.sparkSession
    sizes = members.groupBy("island").agg(F.count("*").alias("members")).filter("members > 1")
    # few rows are one block; more make up to MOST_COPIES blocks (copies of a text), then blocks of MOST_BLOCK
    blocks = F.when(F.col("members") <= 2 * BLOCK, F.lit(1)).otherwise(
        F.greatest(F.least(F.ceil(F.col("members") / BLOCK), F.lit(MOST_COPIES)), F.ceil(F.col("members") / MOST_BLOCK))
    )
    placed = materialise(
        members.join(sizes.withColumn("blocks", blocks.cast("long")), "island")
        .withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
        .select("row", "island", "blocks", "block"),
        "island-members",
    )
    some, _ = split_by_ids(rows.select("row", "text"), placed)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tasks = some.join(placed, "row").withColumn("other", other)
    tasks = tasks.select(
        "island", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "row", "text"
    )
    dealt = tasks.repartition(partitions(spark), "island", "low", "high").sortWithinPartitions("island", "low", "high", "row")
    return stream_arrow(dealt, _forest(match, size), "a long, b long")


def link_components(documents: DataFrame, match: int = MATCH, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, bool]:
    """(row, n, comp) of every document, where comp is the smallest linked row, the rows, and whether rows are doc_ids."""
    rows, plain = with_rows(documents)
    return settled("linked", lambda: _linked(rows, match, size)), rows, plain


def _linked(rows: DataFrame, match: int, size: int) -> DataFrame:
    spark = rows.sparkSession
    rarity = spark.sparkContext.broadcast(word_rarity(rows))
    sets = materialise(_sets(rows, rarity, match, size), "sets")

    some = sets.filter("n > 0")
    # written first: a join of two tables can split the rows of a class of many copies
    classes = materialise(some.groupBy("one", "two", "n").agg(F.min("row").alias("rep")), "class-reps")
    member_of = materialise(some.join(classes, ["one", "two", "n"]).select("row", "rep", "n", "three"), "classes")
    reps = member_of.filter("row = rep").select("row", "n", "three")
    groups = materialise(reps.groupBy("n", "three").agg(F.min("row").alias("id")), "groups")
    leaders = sets.join(groups.select(F.col("id").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "n", "prefix")
    grouped = materialise(reps.join(groups, ["n", "three"]).select("row", "id"), "group-members")
    edges = settled("candidate-edges", lambda: candidate_edges(materialise(leaders, "leaders"), match, None, grouped, rows, size))

    # groups of several members are islands too
    several = grouped.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    islands = components(edges.unionByName(several)).select(F.col("node").alias("id"), F.col("comp").alias("island"))
    members = grouped.join(islands, "id").select("row", "island")
    links = materialise(verified_links(members, rows, match, size), "links")

    linked = components(links).select(F.col("node").alias("rep"), "comp")
    of_class = member_of.join(linked, "rep", "left").select("row", F.coalesce("comp", "rep").alias("comp"))
    return sets.select("row", "n").join(of_class, "row", "left").select("row", "n", F.coalesce("comp", "row").alias("comp"))


def join_classes(documents: DataFrame, match: int = MATCH, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``documents`` (doc_id, text)."""
    out, rows, plain = link_components(documents, match, size)
    if plain:
        return out.select(F.col("row").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
    named = out.join(rows.select("row", "doc_id", "copies"), "row")
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return as_often(named.join(smallest, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "copies"))


def keep_one(documents: DataFrame, match: int = MATCH, size: int = SHINGLE) -> DataFrame:
    """``documents`` with all their columns, without those linked to one of smaller doc_id; of equal rows and ids one stays."""
    out, rows, plain = link_components(documents, match, size)
    kept = out.filter("row = comp")
    id_, hash_ = free(documents, "id_kept", "hash_kept")
    if plain:
        return documents.join(few_broadcast(kept.select(F.col("row").alias(id_))), F.col("doc_id") == F.col(id_), "left_semi")
    text = F.coalesce(F.col("text"), F.lit(""))
    chosen = kept.join(rows, "row").select(F.col("doc_id").alias(id_), F.xxhash64("text").alias(hash_))
    found = documents.join(chosen, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(hash_)), "left_semi")
    return found.dropDuplicates(["doc_id", "text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(table(spark, sf_dir, "documents"))


#: DuckDB SQL for :func:`query`'s rows.
ORACLE = f"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents
),
s as (
  select distinct doc_id, array_to_string(list_slice(ws, p, p + {SHINGLE - 1}), ' ') as shingle from (
    select doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 2))) as p from d where len(ws) > 0
  )
),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= {MATCH} * (na.n + nb.n - k)
),
reach(a, b) as (select doc_id, doc_id from d union select reach.a, links.b from reach join links on reach.b = links.a)
select d.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, min(reach.b) as component_id
from d left join n on n.doc_id = d.doc_id join reach on reach.a = d.doc_id group by d.doc_id
"""
