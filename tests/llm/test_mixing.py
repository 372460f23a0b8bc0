from __future__ import annotations

import random

import pytest

from kinloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def level_targets(sizes: dict, weights=(3, 1, 2), share=1.5, limit=2) -> dict:
    """Share by weight, cut, share the excess again, until none is above."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[n] for n in open_)
        for n in list(open_):
            target[n] += left * weight[n] / total
        left = 0.0
        for n in list(open_):
            if target[n] >= limit * sizes[n]:
                left += target[n] - limit * sizes[n]
                target[n] = float(limit * sizes[n])
                open_.discard(n)
    return target


def corpus(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(int(rnd.paretovariate(1.2) * 10) % 3000)), rnd.choice(["a", "b", "é", "Z", None, "hot", "hot"])) for i in range(n)]
    return [*rows, (n, None, "a"), (n + 1, "", "nothing"), (n + 2, "one two", "tiny"), (3, "w w", "a"), (3, "w w", "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_bounds_and_reruns(spark, seed):
    rows = corpus(seed, 400)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, taken, longest = {}, {}, {}
    for r in got:
        source = r.key[1:] if r.key[0] == "a" else None
        assert 0 <= r.taken <= 2 * r["size"]
        size[source] = size.get(source, 0) + r["size"]
        taken[source] = taken.get(source, 0) + r.taken
        longest[source] = max(longest.get(source, 0), r["size"])
    want = level_targets(size)
    for r in got:
        source = r.key[1:] if r.key[0] == "a" else None
        assert r.source_size == size[source]
        assert r.target == pytest.approx(want[source], rel=1e-9)
    for s in size:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 2), (s, taken[s], want[s])
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rates_have_the_form_of_the_dual(spark):
    """At the solution a document's rate is limit / (1 + exp(-tilt * size / scale))."""
    groups = spark.createDataFrame([("as", x, 100) for x in (5, 20, 80, 300)], "key string, size long, n long")
    wanted = spark.createDataFrame([("as", 40_500, 50_000.0)], "key string, source_size long, target double")
    tilt = mixing.balance(groups, wanted).first()
    import math

    got = sum(100 * x * 2 / (1 + math.exp(-tilt.tilt * x / tilt.scale)) for x in (5, 20, 80, 300))
    assert got == pytest.approx(50_000, rel=1e-5)


def test_small_and_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (None, "", "a")], SCHEMA)
    assert [r.taken for r in mixing.mix(nothing).collect()] == [0, 0]
    one = spark.createDataFrame([(1, "a b c", "s")], SCHEMA)
    assert mixing.mix(one).first().taken in (3, 6)


def test_the_mix_has_the_planned_copies_and_all_columns(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 2], i, "x") for i in range(60)] + [(5, "w w w w w", "b", 5, "y"), (None, "w w", None, 0, "z")]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, size int, copy string")
    plan = mixing.mix(docs).collect()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == ["doc_id", "text", "source", "size", "copy"]
    assert mixed.count() == sum(r.copies for r in plan if r["size"])
    assert "Python" not in mixed._jdf.queryExecution().toString()
