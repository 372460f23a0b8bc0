"""Whitening against numpy's eigenvectors and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from kinloom.llm import whitening


def plain(vectors, count=8):
    """{dimension: (kept rows, n, eigenvalues, vectors, trace, mean, whole entries)}"""
    out = {}
    sound = [(i, v) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    for dim in {len(v) for _, v in sound}:
        rows = [(i, [math.floor(1024 * float(np.float32(x))) + 100_000 for x in v]) for i, v in sound if len(v) == dim]
        x = np.array([r for _, r in rows], dtype=np.float64)
        c = x - x.mean(axis=0)
        cov = c.T @ c / len(x)
        values, unit = np.linalg.eigh(cov)
        out[dim] = (rows, len(x), values[::-1][:count], unit[:, ::-1][:, :count], np.trace(cov), c)
    return out


def check(spark, vectors, count=8, **schema):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = whitening.whiten(df, count=count).collect()
    seen = 0
    for dim, (rows, n, values, unit, trace, c) in plain(vectors, count).items():
        solid = values > dim * 2.3e-16 * values[0]
        want = c @ unit[:, solid] / np.sqrt(values[solid])
        sums = [sum(r[j] for _, r in rows) for j in range(dim)]
        for (i, whole), w in zip(rows, want, strict=True):
            exact = sum((n * v - s) ** 2 for v, s in zip(whole, sums, strict=True))
            mine = [r for r in got if r.vec_id == i and r.n == n and r.deviation == (exact if exact < 2**63 else None)]
            for k in range(solid.sum()):
                some = [r for r in mine if r.component == k + 1]
                assert any(abs(abs(r.whitened) - abs(w[k])) < 1e-6 * max(1, abs(w[k])) for r in some), (i, k)
                assert all(abs(r.explained / (values[k] / trace) - 1) < 1e-6 and r.identity_error < 1e-6 for r in some)
            seen += solid.sum()
        for k in range(solid.sum()):  # one sign for all rows
            at = {r.vec_id: r.whitened for r in got if r.component == k + 1 and r.n == n}
            signs = {np.sign(at[i] * w[k]) for (i, _), w in zip(rows, want, strict=True) if i in at and abs(w[k]) > 1e-3}
            assert len(signs) <= 1
    assert seen == len(got)


def test_random_vectors_and_unsound_ones(spark):
    rnd = np.random.default_rng(3)
    good = [(i, [float(v) for v in row]) for i, row in enumerate((rnd.normal(size=(400, 12)) * np.linspace(0.2, 2, 12)).astype(np.float32))]
    bad = [(1_000, None), (1_001, []), (1_002, [None] * 12), (1_003, [float("nan")] * 12), (1_004, [0.0] * 11 + [float("inf")])]
    check(spark, good + bad)


def test_lengths_are_fitted_apart(spark):
    rnd = np.random.default_rng(4)
    check(spark, [(i, [float(np.float32(v)) for v in rnd.normal(size=3 + i % 2)]) for i in range(60)])


def test_flat_directions_and_few_rows(spark):
    def rows(vectors):
        return whitening.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect()

    assert rows([]) == []
    assert rows([(1, [1.0, 2.0])]) == []
    assert rows([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    got = rows([(1, [0.0, 5.0]), (1, [0.0, 5.0]), (None, [1.0, 5.0]), (4, [1.0, 5.0])])
    assert [(r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in got] == [(1, 4, 4 * 1024**2, 1.0, 1.0)] * 4


def test_far_entries_have_a_defined_result(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0])], "vec_id long, embedding array<float>")).collect()
    assert {(r.vec_id, r.deviation) for r in got} == {(1, None), (2, None), (3, (3 * 4 - 7) ** 2 * 1024**2)}
    assert all(math.isfinite(r.whitened) for r in got) and got[0].identity_error < 1e-6
    wide = [(i, [float(3_000_000 * (i % 7)), float(i)]) for i in range(50)]
    check(spark, wide)


def test_other_columns_and_names(spark):
    df = spark.createDataFrame([(1, [0.0], 7), (2, [1.0], 8)], "k long, v array<double>, whitened int")
    got = whitening.whiten(df, "k", "v")
    assert got.columns == ["k", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 2


@pytest.mark.parametrize("spectrum", [[5.0] * 6, [3, 3, 1, 1, 1e-9, 0], [0] * 6, [1e12, 1, 1e-3, 0, 0, 0], [6, 5, 4, 3, 2, 1], [1, 1, 1, 1, 1, 2]])
def test_divide_and_conquer(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 6)))
    c = q @ np.diag(spectrum) @ q.T
    c = (c + c.T) / 2
    values, vectors = whitening.components(c)
    assert np.allclose(values, sorted(spectrum, reverse=True), atol=1e-13 * max(1, max(spectrum)))
    assert np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-12)
    assert np.allclose(vectors * values @ vectors.T, c, atol=1e-12 * max(1, max(spectrum)))


def test_polar_factor_is_the_sign():
    rnd = np.random.default_rng(2)
    a = rnd.normal(size=(40, 40))
    a = a + a.T
    values, unit = np.linalg.eigh(a)
    assert np.allclose(whitening.polar(a), unit * np.sign(values) @ unit.T, atol=1e-11)


def test_many_dimensions_agree_with_eigh():
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(3_000, 64)) * np.linspace(1, 3, 64)
    c = np.cov(x.T)
    values, vectors = whitening.components(c)
    want, unit = np.linalg.eigh(c)
    assert np.allclose(values, want[::-1], rtol=1e-13)
    assert np.abs(np.abs((vectors * unit[:, ::-1]).sum(axis=0)) - 1).max() < 1e-12
