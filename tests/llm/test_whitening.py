"""Whitening against numpy, exact sums against integers."""

import math

import numpy as np
import pytest

from tidemark.llm import whitening


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def integers(vector):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in vector]


def check(rows, found, components=8):
    x = np.array([integers(v) for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    deviation = sorted(int(((n * row - sums) ** 2).sum()) for row in x)
    y = ((n * x - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, x.shape[1])
    assert len(found) == n * k and {r.n for r in found} == {n}
    assert sorted(r.deviation for r in found if r.component == 1) == deviation
    for c in range(1, k + 1):
        own = sorted(((r.vec_id, r.whitened) for r in found if r.component == c))
        expected = y @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        sign = 1 if max(abs(w - e) for (_, w), e in zip(own, expected)) < 1e-6 else -1
        assert max(abs(sign * w - e) for (_, w), e in zip(own, expected)) < 1e-6
        assert {round(r.explained / (values[c - 1] / values.sum()), 9) for r in found if r.component == c} == {1.0}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


@pytest.mark.parametrize(("n", "dimension"), [(300, 12), (40, 5), (2000, 16)])
def test_against_numpy(spark, n, dimension):
    rng = np.random.default_rng(n)
    vectors = rng.normal(size=(n, dimension)) * np.linspace(3, 0.2, dimension) + rng.normal(size=dimension)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    check(rows, whitening.digest(table(spark, [(i, v, 0) for i, v in rows]).repartition(5)).collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(50)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 0.0, 0.0]), (94, [1.0, 2.0]), (95, []), (96, [1e30, 0.0, 0.0])]
    twice = [(7, good[7][1]), (60, [0.0, 0.0, 0.0])]
    found = whitening.digest(table(spark, [(i, v, 0) for i, v in good + bad + twice])).collect()
    assert len(found) == 52 * 3 and not {r.vec_id for r in found} & set(range(90, 97))
    no_id = whitening.digest(table(spark, [(None, v, 0) for _, v in good])).collect()
    assert len(no_id) == 150 and {r.vec_id for r in no_id} == {None}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 5, [(1, None, 0)]])
def test_nothing_varies(spark, rows):
    assert whitening.digest(table(spark, rows)).count() == 0


def test_components_without_variance_are_left_out(spark):
    rng = np.random.default_rng(3)
    flat = [(i, [float(a), 2 * float(a), 5.0], 0) for i, a in enumerate(rng.integers(-4, 5, size=100))]
    found = whitening.digest(table(spark, flat)).collect()
    assert {r.component for r in found} == {1} and abs(found[0].explained - 1) < 1e-12


def test_deviation_beyond_64_bits_is_null(spark):
    rows = [(i, [float(i) * 2**30, 1.0], 0) for i in range(20)]
    found = {r.vec_id: r.deviation for r in whitening.digest(table(spark, rows)).collect()}
    x = [math.floor(1024 * float(i) * 2**30) + 100_000 for i in range(20)]
    expected = [(20 * v - sum(x)) ** 2 for v in x]
    assert all(found[i] == (e if e < 2**63 else None) for i, e in enumerate(expected)) and None in found.values()


def test_whiten_keeps_columns_and_takes_what_was_learned(spark):
    rng = np.random.default_rng(8)
    rows = table(spark, [(i, rng.normal(size=4).astype(np.float32).tolist(), i % 3) for i in range(200)]).withColumnRenamed("label", "x")
    learned = whitening.fit(rows)
    done = whitening.whiten(rows.filter("x = 1"), found=learned).collect()
    assert [*done[0].asDict()] == ["vec_id", "embedding", "x", "whitened"] and len(done) == 67
    again = whitening.whiten(rows).collect()
    w = np.array([r.whitened for r in again])
    assert np.abs(w.T @ w / len(w) - np.eye(4)).max() < 1e-9
    same = {r.vec_id: r.whitened for r in again}
    assert all(np.allclose(same[r.vec_id], r.whitened) for r in done)
