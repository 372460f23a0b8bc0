"""Spelling variants against every pair of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from kinloom.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(docs, letters=6, count=5):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= letters and n >= count}


def brute_variants(words, times=5):
    out = {}
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if one_edit(w, v)]
        best = min(near, default=None)
        out[w] = (n, best[1] if best and -best[0] >= times * n else None, len(near))

    def root(w):
        return root(out[w][1]) if out[w][1] else w

    return {(w, n, form, words[form] if form else None, root(w), near) for w, (n, form, near) in out.items()}


def variants(spark, words, **how):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return {tuple(r) for r in spelling.variants(df, **how).select("word", "n", "form", "form_n", "root", "n_near").collect()}


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_random_words_in_large_and_small_cells(spark, block):
    rnd = random.Random(block)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9))): rnd.choice([5, 6, 30, 150, 700, 4_000]) for _ in range(900)}
    words |= {"aaaaaa" + "".join(rnd.choice("xyzuvw") for _ in range(rnd.randint(0, 3))): rnd.randint(5, 400) for _ in range(200)}
    assert variants(spark, words, block=block) == brute_variants(words)


def test_edges_of_words(spark):
    words = {"abcdef": 500, "bcdefg": 5, "xabcdef": 6, "abcdefx": 7, "abccdef": 8, "abdcef": 9, "abcde" + "é": 10, "abcdeff": 11, "aabcdef": 12,
             "abxdef": 100, "abxdefé": 20, "ÿÿÿÿÿÿ": 5, "a" * 300: 5, "a" * 299 + "b": 30, "abc" * 400: 6, "abc" * 400 + "d": 60, "×÷×÷×÷": 5}
    assert variants(spark, words) == brute_variants(words)


def test_ties_go_to_the_first_in_code_point_order(spark):
    words = {"abcdef": 5, "abcdeg": 50, "abcdeé": 50, "abcdea": 50, "abcdeaa": 250}
    assert ("abcdef", 5, "abcdea", 50, "abcdeaa", 3) in variants(spark, words)


def test_documents(spark):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdeÀé") for _ in range(rnd.randint(4, 8))) for _ in range(60)]
    docs = [(i, " ".join(rnd.choice(vocabulary).title() if rnd.random() < 0.2 else rnd.choice(vocabulary) for _ in range(60)) + "\u0100-x1") for i in range(300)]
    docs += [(None, "abcdefgh " * 300), (7, None), (7, ""), (8, "abcdefgh" * 20_000), (8, "1 2 3"), (None, None), (9, "ABCDEFGH,abcdefgh;ÀBCDEFGH " * 3)]
    df = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, word string")
    got = {tuple(r) for r in spelling.spelling_variants(df).select("word", "n", "form", "form_n", "root", "n_near").collect()}
    assert got == brute_variants(brute_words(docs))
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_a_crowded_half_is_cut_into_a_grid(spark):
    rnd = random.Random(3)
    words = {"abc" + "".join(rnd.choice("defghi") for _ in range(3)): rnd.randint(5, 90) for _ in range(400)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = spelling.cells(df, 6, 25)
    assert rows.groupBy("room", "asks").count().agg({"count": "max"}).first()[0] <= 60  # a block of 25, spread by hash
    assert variants(spark, words, block=25) == brute_variants(words)
