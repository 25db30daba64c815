import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann


def brute(ids, vectors, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = [(-math.fsum(vectors[i] * vectors[j]), int(ids[j])) for j in range(len(ids)) if j != i]
        out[int(ids[i])] = [j for _, j in sorted(scores)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(3000, 24)).astype(np.float32).astype(float)
    vectors[100:160] = vectors[100]  # ties, more than k of them
    ids = np.arange(3000)
    rows = [(int(i), vectors[i].tolist(), 0) for i in ids]
    found = {}
    for r in ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    expected = brute(ids, vectors, 20)
    assert set(found) == set(expected)
    hits = 0
    for q, rows_ in found.items():
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 21))
        assert rows_ == sorted(rows_, key=lambda r: (-r[2], r[1])) and q not in {r[1] for r in rows_}
        assert all(abs(s - vectors[q] @ vectors[v]) < 1e-12 for _, v, s in rows_)
        hits += len({r[1] for r in rows_} & set(expected[q]))
    assert hits >= 0.9 * 20 * len(expected)
    assert [r[1] for r in found[100]][:19] == list(range(101, 120))


def test_small_and_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (1, [0.0, 0.0], 0), (2, None, 0), (3, [1.0, None], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [1.0], 0), (None, [1.0, 1.0], 0), (20, [2.0, 1.0], 0), (7, [-1.0, -1.0], 0)]
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()]
    assert sorted(found) == [(0, 1, 20, 4.0), (0, 2, 7, -3.0), (20, 1, 0, 4.0), (20, 2, 7, -3.0)]
    assert ann.search(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("block", [40, 7])  # 7: the 15 queries are split too
def test_blocks_of_a_leaf(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)).astype(np.float32).astype(float)
    found = {}
    for r in ann.search(frame(spark, [(i, vectors[i].tolist(), 0) for i in range(300)]), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    expected = brute(np.arange(300), vectors, 20)
    assert {q: [v[i] for i in range(1, 21)] for q, v in found.items()} == expected  # one leaf: every candidate is seen


def test_structured_vectors_need_less(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    vectors = (centres[rng.integers(0, 40, 6000)] + 0.1 * rng.normal(size=(6000, 32))).astype(np.float32).astype(float)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    seen = []
    enough = ann._enough
    monkeypatch.setattr(ann, "_enough", lambda *a: seen.append(enough(*a)) or seen[-1])
    monkeypatch.setattr(ann, "LEAF", 64)
    found = {}
    for r in ann.search(frame(spark, [(i, vectors[i].tolist(), 0) for i in range(6000)]), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    expected = brute(np.arange(6000), vectors, 20)
    assert sum(len(found[q] & set(v)) for q, v in expected.items()) >= 0.9 * 20 * len(expected)
    assert seen[0] < 0.3 * ann.TREES * 6000  # a small part of what all trees hold together
