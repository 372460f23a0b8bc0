"""Language profiles, quality scores, vector search, decontamination, the pipeline."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pytest

from kinloom.llm import decontam, langid, quality, queries, topk
from kinloom.llm.neardup import Sketcher

FOLDER = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    got = queries.op9_language(spark, FOLDER)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = got.collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("x", None), (None, "fr"), ("12", "xx")], "text string, lang string")
    learned = langid.learn_prototypes(train, "text", "lang")
    assert set(learned) == {"en", "de"}
    odd = [None, "", "123 !?", "the mat", "und die", "the " * 50_000, "日本" * 3_000, "\u0301\u0302 ²", "\u0301\u0301 the mat"]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(odd)], "doc_id long, text string, Score string")
    got = {r.doc_id: r for r in langid.predict_language(docs, learned).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "und", "en", "de", "en"]
    assert got[0].score == 0 and got[6].lang_pred in ("de", "en")
    assert (got[7].lang_pred, got[7].score, got[8].lang_pred) == ("und", 0, "en")  # marks alone are no letters
    none = langid.learn_prototypes(train.where("lang is null"), "text", "lang")
    assert {r.lang_pred for r in langid.predict_language(docs, none).collect()} == {"und"}
    assert langid.predict_language(docs.limit(0), learned).count() == 0


def test_bundle_is_the_sum_of_bound_letters():
    profile = langid.bundle(*langid.trigrams(["Ab, c"], np.array([0])), 1, 64, np.float64)[0]
    v = {c: langid.letter_vector(ord(c), 64).astype(int) for c in " abc"}
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in (" ab", "ab ", "b c", " c "))
    assert (profile == want).all()


def test_blocks_of_trigrams_add_up(monkeypatch):
    text = ["".join(chr(0x4E00 + random.Random(k).randrange(3000)) for k in range(500)), "abc"]
    whole = langid.bundle(*langid.trigrams(text, np.arange(2)), 2, 64)
    monkeypatch.setattr(langid, "GRAMS", 37)
    assert (langid.bundle(*langid.trigrams(text, np.arange(2)), 2, 64) == whole).all()


def test_quality_on_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op3_quality(spark, FOLDER).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    labels = [(got[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert sum(p == q for p, q in labels) / len(labels) > 0.95
    assert all(p == 1 for p, q in labels if q == 1)


def test_quality_without_labels_and_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "x", 3), (4, "word " * 100_000, 3), (4, "word", 3)], "doc_id long, text string, predicted int")
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    got = quality.score_quality(docs, none)
    assert sorted(got.columns) == ["doc_id", "held_out", "predicted", "score"]
    assert {(r.score, r.predicted) for r in got.collect()} == {(0.0, 0)}
    one = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (4, 1)], "doc_id long, quality int")
    rows = quality.score_quality(docs, one).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)


def test_isotonic_pooling():
    got = quality.pool(np.array([0, 3, 1, 4.0]), np.array([2, 3, 4, 4.0]))
    assert got.tolist() == [0, 4 / 7, 4 / 7, 1]


def vectors(seed: int, n: int, dim: int):
    rnd = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rnd.normal(size=dim).round(1)]) for i in range(n)]
    return rows + [(200, None), (300, [1.0, None] + [0.0] * (dim - 2)), (301, [float("nan")] * dim), (302, [float("inf")] * dim), (None, rows[0][1]),
                   (100, rows[100][1]), (7, rows[7][1])]


@pytest.mark.parametrize(("seed", "dim", "k", "block"), [(1, 4, 10, 4096), (2, 16, 3, 64)])
def test_top_k_equals_brute_force(spark, seed, dim, k, block):
    rows = vectors(seed, 250, dim)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(table, k=k, block=block, query_block=2, pivots=5).orderBy("query_id", "rank").collect()
    sound = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for query in sorted({i for i, _ in sound if i % 100 == 0}):
        q = min(v for i, v in sound if i == query)
        want = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in sound if i != query))[:k]
        assert [(-r.score, r.vec_id) for r in got if r.query_id == query] == want


def test_top_k_of_small_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, score int")
    assert topk.top_k(empty).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1.0, 2.0]), (3, [])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(few).collect()] == [(0, 1, 1, 1024 * 2048)]


def contaminated(seed: int):
    rnd = random.Random(seed)
    word = [f"w{i}" for i in range(300)]

    def text(n):
        return " ".join(rnd.choice(word) for _ in range(n))

    items = [(i, text(rnd.randrange(5, 60))) for i in range(30)] + [(90, None), (91, "too short item"), (None, text(20)), (92, "the " * 12)]
    docs = [(1000, None), (1001, ""), (1002, "w1 w2"), (1003, "the " * 300)]
    for i, (_, item) in enumerate(items[:30]):
        w = item.split()
        edited = list(w)
        edited[rnd.choice([0, -1, len(w) // 2])] = "changed"
        docs += [(i, text(40) + "\n" + item.upper().replace(" ", ", ") + " " + text(40)), (100 + i, text(9) + " " + " ".join(edited) + " " + text(9)),
                 (200 + i, text(60)), (300 + i, " ".join(w[:-1])), (400 + i, " ".join(w[1:]) + " " + text(3))]
    return docs, items


@pytest.mark.parametrize("words", [decontam.BLOCK_WORDS, 50])
def test_contamination_equals_all_windows(spark, monkeypatch, words):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
    rows, items = contaminated(1)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, similarity int")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_contamination(docs, table).collect()
    want = brute.contamination(rows, items, 0.8)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(0.8 <= r.similarity <= 1 for r in got)
    left = decontam.drop_contaminated(docs, table)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {d for d, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(docs, none).count() == 0 and decontam.drop_contaminated(docs, none).count() == len(rows)


def random_word(rnd):
    return "".join(rnd.choice("abcdefghijklmnop") for _ in range(8))


@pytest.mark.parametrize("exact", [False, True])
def test_windows_at_the_least_similarity_are_found(exact):
    """Item of ``n`` shingles, the last ``r`` of them replaced in the document: similarity (n - r) / (n + r)."""
    rnd = random.Random(8)
    for n, r, pairs in ((9, 1, 1000), (18, 2, 300), (25, 2, 200), (46, 5, 200), (90, 10, 100)):
        items = [[random_word(rnd) for _ in range(n + 4)] for _ in range(pairs)]
        index = decontam.Index([(i, " ".join(w)) for i, w in enumerate(items)], 0.8, exact)
        texts = [" ".join([random_word(rnd), *w[:n + 4 - r], *(random_word(rnd) for _ in range(r + 3))]) for w in items]
        assert [[m[0] for m in f] for f in index.matches(texts, {})] == [[i] for i in range(pairs)]


def test_items_with_repeated_shingles_are_found():
    rnd = random.Random(10)
    for n, r, pairs in ((9, 1, 300), (46, 5, 200), (90, 10, 100)):
        items = [([random_word(rnd) for _ in range(rnd.choice([1, 2, 6]))] * n)[:n + 2 - r] + [random_word(rnd) for _ in range(r + 2)] for _ in range(pairs)]
        index = decontam.Index([(i, " ".join(w)) for i, w in enumerate(items)], 0.8)
        texts = [" ".join([*w[:n + 4 - r], *(random_word(rnd) for _ in range(r))]) for w in items]
        found = index.matches(texts, {})
        assert all(i in [m[0] for m in f] for i, f in enumerate(found))


def test_fingerprints_at_the_least_similarity_stay_within_the_radius():
    rnd, maker = random.Random(11), Sketcher(5)
    for n, r in ((9, 1), (18, 2), (45, 5), (90, 10)):
        ours = [[random_word(rnd) for _ in range(n + 4)] for _ in range(1_000)]
        theirs = [w[:n + 4 - r] + [random_word(rnd) for _ in range(r)] for w in ours]
        a, b = (decontam.fingerprints(maker.shingles(w)[0], np.arange(1_000) * n, n) for w in (ours, theirs))
        far = decontam.apart(a, b)
        assert far.max() <= decontam.RADIUS and far.mean() + 4.5 * far.std() < decontam.RADIUS + 1


def test_a_document_shorter_than_an_item_is_found_at_the_least_similarity():
    rnd = random.Random(9)
    items = [[random_word(rnd) for _ in range(14)] for _ in range(1500)]
    index = decontam.Index([(i, " ".join(w)) for i, w in enumerate(items)], 0.8)
    assert [[m[0] for m in f] for f in index.matches([" ".join(w[2:]) for w in items], {})] == [[i] for i in range(1500)]


def test_blocks_find_every_fingerprint_within_the_radius():
    rnd = random.Random(4)
    index = decontam.Index([(i, " ".join(f"w{rnd.randrange(12)}" for _ in range(12))) for i in range(200)], 0.8)
    prints = index.prints.copy()
    for k in range(len(prints)):
        for b in rnd.sample(range(128), decontam.RADIUS):
            prints[k, b // 16] ^= np.uint16(1 << b % 16)
    found = set(index.within(prints, 5, 8))
    want = {(a, b) for a in range(200) for b in range(200) if decontam.apart(prints[a], index.prints[b]) <= decontam.RADIUS}
    assert found == want and {(k, k) for k in range(200)} <= found
    assert list(index.within(prints, 5, 9)) == []
    assert len(Sketcher(5).shingles([["a"] * 4, [], ["b"] * 9])[0]) == 6


def test_short_items_are_whole_word_sequences(spark):
    items = spark.createDataFrame([(1, "Two words"), (2, "one"), (3, "a b c d"), (4, "..."), (5, None), (None, "x"), (6, "a b c d e"), (6, "q r")], "item_id long, text string")
    rows = [(1, "say TWO  words, two words"), (2, "oneself"), (3, "ONE"), (4, "z a b c d"), (5, "a b c d e f"), (6, None), (7, ""), (None, "q-r"), (7, "two word s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in decontam.find_contamination(docs, items).collect())))
    assert got == sorted(map(str, [(1, 1, 1, 2, 1.0), (3, 2, 0, 1, 1.0), (4, 3, 1, 4, 1.0), (5, 3, 0, 4, 1.0), (5, 6, 0, 5, 1.0), (None, 6, 0, 2, 1.0)]))
    assert sorted(r.text or "" for r in decontam.drop_contaminated(docs, items).collect()) == ["", "", "oneself", "two word s"]


def test_items_and_documents_in_many_cells(spark, monkeypatch):
    rows, items = contaminated(3)
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.find_contamination(docs, table).collect()))
    for bits in (decontam.MOST_BITS, 6):  # a sieve that lets everything through changes nothing
        monkeypatch.setattr(decontam, "BLOCK_WORDS", 60)
        monkeypatch.setattr(decontam, "CELL_CHARS", 500)
        monkeypatch.setattr(decontam, "MOST_BITS", bits)
        assert sorted(map(tuple, decontam.find_contamination(docs, table).collect())) == whole and whole
        assert sorted(map(tuple, decontam.find_contamination(docs, table, exact=True).collect())) == whole


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(900_001, None, None, None, 0), (900_002, "123 ...", "en", "src0", 7), (None, docs.first().text, "en", None, 1)], docs.schema)
    rows, at = {}, docs.unionByName(odd)
    for name, stage in pipeline.STAGES:
        at = stage(spark, at, FOLDER).cache()
        rows[name] = at.collect()
        if name != "mixing":
            assert at.columns == docs.columns
    ids = {n: [r.doc_id for r in x] for n, x in rows.items()}
    assert {900_001, 900_002} & set(ids["language"]) == set() and len(ids["language"]) == docs.count() + 1
    named = [(r.doc_id, r.text) for r in rows["language"] if r.doc_id is not None]
    assert sorted(i for i in ids["near_duplicates"] if i is not None) == sorted({c for c in brute.components(named, 5, 80).values()})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute.contamination([(i, t) for i, t in ((r.doc_id, r.text) for r in rows["near_duplicates"]) if i in set(sum_hits(rows, items))], items, 0.8)}
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == leaks
    assert sorted(map(str, ids["personal_data"])) == sorted(map(str, ids["decontamination"]))
    assert not any(brute.base_spans(r.text) for r in rows["personal_data"])
    assert all(r.copy in (1, 2) for r in rows["mixing"])


def sum_hits(rows, items):
    """Documents that share five words in a row with any item: only these can hold one."""
    import re

    grams = set()
    for _, t in items:
        w = re.findall(r"\w+", t.lower())
        grams |= {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    for r in rows["near_duplicates"]:
        w = re.findall(r"\w+", r.text.lower())
        if any(tuple(w[i:i + 5]) in grams for i in range(len(w) - 4)):
            yield r.doc_id
