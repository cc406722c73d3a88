"""The training-data operators against brute force, the tokenizers library and plain rules, with the odd cases."""

import hashlib
import json
import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chromaflow.llm import bpe, html_text, jaccard_join, licenses, mixing, pieces, recompression, repetition, rule_quality, substring_dedup, token_orc
from chromaflow.llm import kernels as K

#: Columns whose names clash with what operators use inside.
CLASH = {"row": 1, "n": 2, "key": "k", "copies": 3, "_id": 4, "id_kept": 5, "text_changed": "z", "size": 6, "score": 0.5, "ranges": None, "prefix": None, "copy_taken": 1}
CLASH_DDL = "row long, n long, key string, copies long, _id long, id_kept long, text_changed string, size long, score double, ranges string, prefix string, copy_taken long"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", (sources or ["a", "b", None])[k % 3], len(t or ""), *CLASH.values()) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASH_DDL}").repartition(3)


def words(text):
    return (text or "").encode().split()


def nasty_texts(seed=5, n=120):
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") for _ in range(300)]
    out = [None, "", " \n\t ", "x " * 3000, "Ünï cödé 漢字 " * 30, "a", "a b", "a b c", "\x1c\x85\xa0z", "<|endoftext|> hi <|startoftext|>"]
    while len(out) < n:
        k = rng.random()
        if k < 0.25:
            out.append(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 120))))
        elif k < 0.4:
            out.append(" ".join(["x"] * rng.randint(0, 60)) + "\n" + " ".join(["y", "z"] * rng.randint(0, 40)))
        elif k < 0.7:
            a = rng.randint(0, 250)
            out.append(" ".join(base[a : a + rng.randint(10, 60)]) + "  \n" + " ".join(rng.choice("pqrstuv") for _ in range(30)))
        elif k < 0.85:
            own = list(base[:80])
            own[rng.randrange(80)] = "Changed"
            out.append(" ".join(own))
        else:
            out.append(out[rng.randrange(len(out))])
    return out


TEXTS = nasty_texts()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], f"{DOCS}, {CLASH_DDL}")


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, shared and missing ids."""
    return frame(spark, [TEXTS[20], TEXTS[20], TEXTS[30], None, TEXTS[20], TEXTS[30], "", TEXTS[40]], [1, 1, 1, 2, None, None, 3, 5]).cache()


# --- kernels


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té漢\x1c\xa0", max_size=12), min_size=1, max_size=6))
def test_words_are_those_of_bytes_split(texts):
    for first, stop, buf, offsets in K.chunks(pa.array(texts)):
        own = K.Words(buf, offsets)
        got = [[bytes(buf[a:b]) for a, b in zip(own.start[x:y], own.end[x:y])] for x, y in zip(own.first[:-1], own.first[1:])]
        assert got == [words(t) for t in texts[first:stop]]
        by_word = defaultdict(set)
        for w, h in zip([w for ws in got for w in ws], own.hashes().tolist()):
            by_word[w].add(h)
        assert all(len(x) == 1 for x in by_word.values()) and len(set.union(set(), *by_word.values())) == len(by_word)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=0, max_size=120), st.integers(0, 5))
def test_equal_windows_pick_equal_symbols(tokens, shift):
    text = " ".join(tokens)
    picked = {}
    for _, _, buf, offsets in K.chunks(pa.array([text, "q " * shift + text, text + " r r"])):
        own = K.Words(buf, offsets)
        key, place = recompression.anchors(own.hashes(), own.doc, 12)
        for p in np.flatnonzero(place >= 0):
            content = bytes(buf[own.start[p] : own.end[p + 11]])
            pick = int(key[p]), int(place[p] - p)
            assert picked.setdefault(b" ".join(content.split()), pick) == pick


# --- 1 main text


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site name</h1></header>
<ul class="menu"><li><a href=x>Home</a><li><a href=y>News</a></ul><div><article><h1>Head &amp; line</h1><p>First  paragraph<b> of</b> the
text, long enough to read.<p>Short.</p><div class="ad">Buy this now, it is cheap.</div><script>var a="</p><p>no";</script><p>Last one &#233;.</p>
<section class="comments"><p>I liked it a lot, thank you for this article.</p></section></article></div>
<aside>Other things</aside><form>Name <input></form><div id="cookie-notice">We use cookies.</div><footer>&copy; 2020</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nFirst paragraph of the text, long enough to read.\nShort.\nLast one é."
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert "First paragraph" in html_text.main_text(plain) and "cookies" not in html_text.main_text(plain)
    for x in (None, "", "<", "<p", "<!--", "<script>never closed", "</div></div>"):
        assert html_text.main_text(x) == ""


def test_main_text_of_compound_names():
    """States and topics in class names, marks that differ and elements that never close lose no article."""
    long = "The river rose for three days and then it fell again, and people came back to their houses. " * 3
    for opening in ('<main class="content has-sidebar">', '<div id="main" class="no-sidebar">', '<article class="post comments-open">', '<article class="post category-legal">', '<article class="post tag-search">', '<div class="entry share">', '<main class="sidebar">'):
        tag = opening[1:].split()[0]
        assert html_text.main_text(f"<body>{opening}<p>{long}</p><p>Short.</p></{tag}></body>") == f"{long.strip()}\nShort.", opening
    for name in ("site-footer", "sidebar-left", "comment-list", "share-buttons", "related-content", "ad", "comment-12"):
        assert html_text.main_text(f'<main><p>{long}</p><div class="{name}"><p>{long}</p></div></main>') == long.strip(), name
    for inert in ("button", "svg", "select", "template"):
        assert long.strip() in html_text.main_text(f"<body><div><{inert}>x</div><article><p>{long}</p></article><div><{inert}>y</{inert}></div></body>"), inert
        assert html_text.main_text(f"<body><article><{inert}><div>Press</div></{inert}><p>{long}</p></article></body>") == long.strip(), inert


def test_cut_joins_blocks_of_unlike_evidence():
    blocks = html_text.blocks_of('<div class="promo">One</div><article>Two</article><nav>Three</nav><p>Four</p>')
    assert {(0, 1), (1, 2), (2, 3)} <= {e[:2] for e in html_text.edges_of(blocks)} and len({b.evidence for b in blocks}) == 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-30, 30), min_size=1, max_size=7), st.data())
def test_cut_is_cheapest(z, data):
    n = len(z)
    edges = [(a, b, w / 10) for a in range(n) for b in range(a + 1, n) if (w := data.draw(st.integers(0, 25)))]
    z = [x / 10 for x in z]

    def cost(label):
        return sum(abs(x) for x, s in zip(z, label) if (x > 0) != s and x) + sum(w for a, b, w in edges if label[a] != label[b])

    best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert cost(html_text.cut(z, edges)) == pytest.approx(best, abs=1e-6)


def test_pages(spark, sf_dir):
    rows = [(1, "u", PAGE, 0), (2, None, None, 0), (None, "v", "", 0), (2, None, None, 0)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in got) == [(0, 0, 0), (1, len(html_text.main_text(PAGE)), len(html_text.main_text(PAGE))), (2, 0, 0), (2, 0, 0)]
    assert html_text.query(spark, sf_dir).filter("n_chars > 0").count() == 50


# --- 2 repetition


def brute_repetition(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [0] * len(w)
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [1] * 8
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * sum(hit) > 30 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), again, sum(hit), failed


def test_repetition(docs, empty, odd):
    got = {r.doc_id: r for r in repetition.repetition_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_repetition(t)
        assert not (r.kept and r.base_failed)
    assert repetition.repetition_rules(empty).count() == 0 and repetition.repetition_rules(odd).count() == 8
    kept = repetition.quality_filter(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


# --- 3 mixing


def test_mixing(spark, docs, empty, odd):
    rng = random.Random(1)
    many = frame(spark, ["w " * rng.randint(1, 40) for _ in range(900)] + [None, ""], sources=["a", "b", None])
    rows = mixing.mix(many).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(many.repartition(2)).collect()}
    assert {(r.doc_id, r.taken) for r in rows} == again and len(rows) == 902
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source].append(r)
    assert set(by) == {"a", "b", None}
    share = {"a": 5 / 8, "b": 2 / 8, None: 1 / 8}
    cap = {s: 2 * sum(r["size"] for r in v) for s, v in by.items()}
    assert by["a"][0].target == cap["a"]  # 5/8 of 150% is more than twice its size
    left = 1.5 * total - cap["a"]
    for s in ("b", None):
        assert by[s][0].target == pytest.approx(min(left * share[s] / (3 / 8), cap[s]))
    for s, v in by.items():
        assert abs(sum(r.taken for r in v) - v[0].target) <= 2
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).count() == 8
    for own in (docs, odd):
        mixture = mixing.mixed_documents(own)
        assert mixture.columns == own.columns
        assert mixture.count() == mixing.mix(own).agg(F.sum("copies")).first()[0]


# --- 4 and 9 tokens


ALPHABET = ["a", "e", "n", "the", "A", "É", "İ", "ſ", "²", "ñ", "́", "漢", "🙂", "'s", "'T", "'RE", " ", "\n", "\xa0", "\x1c", "\x85", "_", "-", "<|endoftext|>", "</w>", "<|", "0", "Ω", "ß", "abab"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join))
def test_encoding_is_that_of_the_library(text):
    path = pieces.default_vocabulary()
    want = pieces.library(path).encode(text, add_special_tokens=False).ids
    own = bpe.codec(path)
    assert own.encode(text) == want
    count, ids, decoded = own.forms(pa.array([text, "", text]))
    assert count.tolist() == [len(want), 0, len(want)] and ids.to_pylist() == [" ".join(map(str, want)), "", " ".join(map(str, want))]
    assert decoded[0].as_py() == decoded[2].as_py() == pieces.library(path).decode(want, skip_special_tokens=False) and decoded[1].as_py() == ""
    got, n = token_orc.word_encoder(path)(pa.array([text, "", text]))
    assert got.tolist() == want * 2 and n.tolist() == [len(want), 0, len(want)]


def test_words_are_cut_alike_by_column_and_one_by_one():
    safe = [chr(c) for c in range(0x21, 0x180) if pieces._SAFE.fullmatch(chr(c))]
    words = [a + b for a in safe for b in ["", "'s", "1_-", "é'LL", *"aZ0_'."]] + ["'s", "''S'", "!'ve", "1'23", "don't've"]
    got = pieces.cut_words(pa.array(words))
    assert got.to_pylist() == [pieces.cut_word(w.lower()) for w in words]


def test_encoder_with_a_full_table_gives_the_same_ids(monkeypatch):
    path = pieces.default_vocabulary()
    library, own = pieces.library(path), token_orc.WordEncoder(path)
    other = bpe.codec(path).columns
    monkeypatch.setattr(pieces, "CACHE_PIECES", 50)
    draw = random.Random(3)
    for _ in range(6):
        texts = [" ".join("".join(draw.choices("aebT'.1", k=draw.randrange(1, 60))) for _ in range(20)) for _ in range(5)]
        ids, n = own(pa.array(texts))
        want = [library.encode(x, add_special_tokens=False).ids for x in texts]
        assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
        assert [x.tolist() for x in other(pa.array(texts))] == [ids.tolist(), n.tolist()]


@pytest.mark.parametrize("most", [1, 7, 100, 1 << 20])
def test_slices_hold_all_texts_in_order(monkeypatch, most):
    texts = ["", "a b c", "", "x " * 300, *(x or "" for x in TEXTS), "", "é" * 50]
    column = pa.array(["cut off", *texts])[1:]
    parts = bpe.slices(column, most)
    assert [x for p in parts for x in p.to_pylist()] == texts and all(len(p) for p in parts)
    assert all(sum(len(x.encode()) for x in p.to_pylist()[1:]) < most for p in parts)
    own = bpe.codec(pieces.default_vocabulary())
    monkeypatch.setattr(bpe, "SLICE_BYTES", most)
    n, of_ids, of_text = own.digests(column)
    want = [own.library.encode(x, add_special_tokens=False).ids for x in texts]
    assert n == list(map(len, want)) and of_ids == [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in want]
    assert of_text == [hashlib.sha256(own.library.decode(x, skip_special_tokens=False).encode()).hexdigest() for x in want]


#: Takes the function that a task runs, gives it batches of 8 MB with ever new words, and prints what that adds to a worker with a vocabulary, in KB.
BATCHES = """
import random, threading, time
import pyarrow as pa
from chromaflow.llm import bpe, pieces

def now():
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmRSS"))

def watch():
    while True:
        most[0] = max(most[0], now())
        time.sleep(0.005)

draw, found = random.Random(1), []
often = ["".join(draw.choices("abcdefghijklmnopqrst", k=6)) for _ in range(20_000)]
def batch():
    texts = [" ".join(draw.choices(often, k=400) + ["".join(draw.choices("aeioubdklmnrst", k=9)) for _ in range(20)]) for _ in range(2800)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
batches = [batch() for _ in range(4)]
bpe.map_arrow, bpe.texts = lambda df, run, schema: found.append(run), lambda df: df
bpe.encode_decode_digests(None)
bpe.codec(pieces.default_vocabulary())
least = now()
most = [least]
threading.Thread(target=watch, daemon=True).start()
for b in batches:
    found[0](b)
print(most[0] - least)
"""


def test_a_batch_takes_little_memory_beside_the_vocabulary():
    ran = subprocess.run([sys.executable, "-c", BATCHES], capture_output=True, text=True, env=os.environ, check=True)
    assert int(ran.stdout) < 120_000


def test_bpe_query(docs, empty, odd):
    library = pieces.library(pieces.default_vocabulary())
    for r in bpe.encode_decode_digests(docs).collect():
        want = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode_digests(empty).count() == 0 and bpe.encode_decode_digests(odd).count() == 8
    back = bpe.decode(bpe.encode(docs)).filter("doc_id = 7").first()["text"]
    assert back == library.decode(library.encode("a b c", add_special_tokens=False).ids, skip_special_tokens=False)


def test_token_orc(spark, docs, empty, odd, tmp_path):
    library = pieces.library(pieces.default_vocabulary())
    out = str(tmp_path / "t")
    token_orc.write_token_orc(docs, out, shards=3)
    start = 0
    for r in token_orc.digests(token_orc.read_token_orc(spark, out)).orderBy("doc_id").collect():
        ids = [*library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id for r in token_orc.find_documents(spark, out, [5, 7]).collect()} == {5, 7}
    for name, own, n in (("e", empty, 0), ("o", odd, 8)):
        token_orc.write_token_orc(own, str(tmp_path / name))
        assert token_orc.read_token_orc(spark, str(tmp_path / name)).count() == n


def rows_scanned(df):
    """Rows that the scan of a plan without exchanges gave."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_lookups_skip_row_groups(spark, tmp_path):
    out = str(tmp_path / "many")
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    token_orc.write_token_orc(docs, out, shards=3)
    # row groups hold 1,000 rows
    assert rows_scanned(spark.read.schema(token_orc.SCHEMA).orc(out)) == 30_000
    found = token_orc.find_documents(spark, out, [12_345])
    assert rows_scanned(found) <= 1_000 and [r.doc_id for r in found.collect()] == [12_345]
    # inside every row group's bounds, but in none: the Bloom filters know
    gaps = str(tmp_path / "gaps")
    token_orc.write_token_orc(docs.withColumn("doc_id", F.col("doc_id") * 1_000), gaps, shards=3)
    assert rows_scanned(token_orc.find_documents(spark, gaps, [12_345_678])) <= 1_000


def test_rows_of_one_id_are_dealt_over_shards(spark, tmp_path):
    out = str(tmp_path / "same")
    docs = spark.range(4_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.col("id") * 7 % 4_000, F.lit(" w")).alias("text"))
    token_orc.write_token_orc(docs, out, shards=4)
    sizes = [r["count"] for r in spark.read.schema(token_orc.SCHEMA).orc(out).groupBy("shard").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2_000


# --- 5 quality


def test_rule_ensemble(spark, sf_dir, docs, empty):
    from chromaflow.llm.common import table

    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = rule_quality.train(d, labels)
    got = rule_quality.score_quality(d, model).join(labels, "doc_id").toPandas()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"]))
    good, bad = got[got["quality"] == 1]["score"], got[got["quality"] == 0]["score"]
    assert (good.to_numpy()[:, None] > bad.to_numpy()).mean() > 0.95
    stats = rule_quality.with_statistics(docs).toPandas()
    x = stats[list(rule_quality.STATISTICS)].to_numpy(float)
    assert np.isfinite(x).all()
    scored = rule_quality.score_quality(docs, model).toPandas().set_index("doc_id")["score"]
    assert np.allclose(model.predict(x), scored.loc[stats["doc_id"]].to_numpy())
    assert rule_quality.score_quality(empty, model).count() == 0
    nothing = rule_quality.train(docs, labels.filter("false"))
    assert rule_quality.score_quality(docs, nothing).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)


# --- 7 Jaccard join


def brute_components(texts, match=90, size=3):
    lower = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    sets = []
    for t in texts:
        w = lower((t or "").encode()).split()
        sets.append(frozenset(tuple(w[p : p + size]) for p in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    comp = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and 100 * both >= match * len(sets[x] | sets[y]) and comp[x] != comp[y]:
                a, b = sorted((comp[x], comp[y]))
                comp = [a if c == b else c for c in comp]
    return [(len(s), c) for s, c in zip(sets, comp)]


@pytest.mark.parametrize("match, size, bucket", [(90, 3, 32), (80, 5, 4)])
def test_join(spark, docs, match, size, bucket, monkeypatch):
    rng = random.Random(match)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [rng.choice(vocabulary) for _ in range(70)]
    texts = TEXTS[:60]
    for _ in range(220):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(70)] = rng.choice(vocabulary)
        texts = [*texts, " ".join(own)]
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_classes(frame(spark, texts), match, size).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, match, size)


def test_join_odd(docs, empty, odd):
    assert jaccard_join.join_classes(empty).count() == 0
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard_join.join_classes(odd).collect())
    assert len(got) == 8 and got.count(("1", 1)) == 3 and ("3", 3) in got
    kept = jaccard_join.keep_one(docs)
    want = {i for i, (_, c) in enumerate(brute_components(TEXTS)) if c == i}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert jaccard_join.keep_one(odd).columns == odd.columns and jaccard_join.keep_one(empty).count() == 0


# --- 8 repeated passages


def brute_removal(texts, window=20):
    first, out = {}, []
    tokens = [words(t) for t in texts]
    for i, w in enumerate(tokens):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
    for i, w in enumerate(tokens):
        hit = [0] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                hit[p : p + window] = [1] * window
        out.append((len(w), sum(hit), b" ".join(x for x, h in zip(w, hit) if not h)))
    return out


def test_removal_of_wide_windows(spark):
    """Stretches of more windows than the row's count holds: unique texts and first occurrences stay."""
    rng = np.random.default_rng(8)
    words = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 400)) for _ in range(40)]
    texts = [(k, t) for k, t in enumerate(words)] + [(100 + k, " ".join(t.split()[90:290])) for k, t in enumerate(words[:12])]
    got = substring_dedup.removal(spark.createDataFrame([(k, t, "s") for k, t in texts], "doc_id long, text string, source string"), 80).collect()
    assert {r.doc_id: r.n_removed for r in got} == {k: 0 if k < 100 else 200 for k, _ in texts}


def test_removal(docs, empty, odd):
    want = brute_removal(TEXTS)
    for r in substring_dedup.removal(docs).collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept).hexdigest())
    spans = substring_dedup.repeated_spans(docs).groupBy("doc_id").agg(F.sum("n_words")).collect()
    assert {r[0]: r[1] for r in spans} == {i: w[1] for i, w in enumerate(want) if w[1]}
    stripped = substring_dedup.strip_repeats(docs)
    assert stripped.columns == docs.columns
    for r in stripped.collect():
        assert b" ".join(words(r.text)) == want[r.doc_id][2]
        assert r.text == TEXTS[r.doc_id] or r.n_chars == len(r.text)
    assert substring_dedup.removal(empty).count() == 0 and substring_dedup.removal(odd).count() == 8
    assert substring_dedup.strip_repeats(odd).count() == 8 and substring_dedup.strip_repeats(empty).count() == 0


# --- 10 licences


def test_license_query(docs, empty, odd):
    assert licenses.license_scan(docs).count() == len(TEXTS) and licenses.license_scan(empty).count() == 0 and licenses.license_scan(odd).count() == 8
    assert licenses.license_spans(docs).columns[0] == "doc_id"


# --- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    kept = sorted(i for i, t in rows.items() if repetition.verdict(repetition.measure(*next((b, o) for _, _, b, o in K.chunks(pa.array([t or ""])))))[1][0])
    comps = brute_components([rows[i] for i in kept], 80, 5)
    kept = [i for k, i in enumerate(kept) if comps[k][1] == k]
    texts = {i: w[2].decode() for i, w in zip(kept, brute_removal([rows[i] for i in kept]))}
    library = pieces.library(pieces.default_vocabulary())
    want = {}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert all(want[i] == (n, sha) and 1 <= k <= 2 for (i, n, sha), k in got.items())
    taken = sum(len(texts[i].split()) * k for (i, _, _), k in got.items())
    assert abs(taken - 1.5 * sum(len(t.split()) for t in texts.values())) < 0.02 * taken
    assert json.dumps([name for name, _ in corpus_pipeline.STAGES])
