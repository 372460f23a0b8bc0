from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from kinloom.llm import neardup


def near_copies(seed: int) -> list[tuple[int, str | None]]:
    rnd = random.Random(seed)
    word = [f"w{i}" for i in range(400)]
    texts: list[str | None] = [None, "", " \t\n", "one", "One", "two words", "two  words", "Three\nwords here", "three words here"]
    for _ in range(12):
        base = [rnd.choice(word) for _ in range(rnd.randrange(3, 120))]
        for _ in range(rnd.randrange(1, 9)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 7)):
                copy[rnd.randrange(len(copy))] = rnd.choice(word)
            texts.append(" ".join(copy))
    # a chain: neighbours are similar, the ends are not
    chain = [rnd.choice(word) for _ in range(100)]
    for k in range(12):
        texts.append(" ".join(chain[4 * k:4 * k + 60]))
    texts += [texts[12]] * 30 + ["Ä é" + "x" * 50_000]
    rnd.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 80), (2, 5, 80), (3, 4, 60)])
def test_components_equal_comparison_of_all_pairs(spark, seed, n, percent):
    docs = near_copies(seed)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), n=n, percent=percent).collect()
    want = brute.components(docs, n, percent)
    assert len(got) == len(docs)
    if percent < 80:  # bands are made for 0.8; below, links may be missed but never invented
        assert all(want[r.doc_id] <= r.component_id for r in got)
        return
    texts = dict(docs)
    for r in got:
        assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), texts[r.doc_id]
        assert r.n_shingles == len(brute.shingles(texts[r.doc_id], n))


def test_shuffled_texts_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.createDataFrame(near_copies(4), "doc_id long, text string")
    want = sorted(map(str, neardup.near_duplicates(docs, n=4).collect()))
    monkeypatch.setattr(neardup, "SMALL", 0)
    assert sorted(map(str, neardup.near_duplicates(docs, n=4).collect())) == want


def test_nulls_repeated_ids_and_no_rows(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "a b c d e f g"
    rows = [(None, text), (7, text), (7, text), (9, text), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_shingles int, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(7, 3, 7, True), (7, 3, 7, True), (9, 3, 7, False), (None, 0, None, True), (None, 3, None, True)], key=str)


def test_signature_values_agree_as_often_as_sets_do():
    rnd = np.random.default_rng(3)
    base = neardup.mixed(rnd.integers(0, 2**63, 1200, dtype=np.uint64))
    a, b = base[:1000], base[200:]
    made = neardup.Sketcher(4).signatures(np.r_[a, b], np.array([1000, 1000]))
    assert abs((made[0] == made[1]).mean() - 800 / 1200) < 0.12


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)], "a long, b long").repartition(4)
    assert {r.comp for r in neardup.components(edges).collect()} == {1}


def test_slices_hold_little_text(monkeypatch):
    monkeypatch.setattr(neardup, "SLICE_ROWS", 3)
    monkeypatch.setattr(neardup, "SLICE_BYTES", 10)
    cut = lambda *sizes: list(neardup.slices(np.array(sizes, dtype=np.int64)))
    assert cut(1, 1, 1, 1) == [(0, 3), (3, 1)]
    assert cut(6, 5, 50, 0, 2) == [(0, 1), (1, 1), (2, 1), (3, 2)]
    assert cut() == [] and cut(0, 0, 99) == [(0, 2), (2, 1)]
