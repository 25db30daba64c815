"""Repeated strings: the arrays against plain sorting, the whole against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import documents
from tidemark.llm import suffixes


def brute(texts, length):
    """Per text: bytes, bytes removed, runs of them, and what is left."""
    raws = [(t or "").encode() for t in texts]
    starts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    found = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if starts[r[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(b for b, g in zip(r, gone) if not g)
        found.append((len(r), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return found


def same(spark, rows, length=suffixes.LENGTH, anchor=suffixes.ANCHOR, shard=suffixes.SHARD):
    got = suffixes.digest(documents(spark, rows).repartition(3), length, anchor, shard).collect()
    expected = [(i, *found) for (i, *_), found in zip(rows, brute([r[1] for r in rows], length))]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=8, max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8))
def test_shard(strings):
    length = 8
    begins, flags, distinct, data = suffixes.repeated(strings, length)
    starts = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    for begin, s in zip(begins.tolist(), strings):
        for i in range(len(s) + 1):
            assert flags[begin + i] == (i + length <= len(s) and starts[s[i : i + length]] > 1)
    kept = [data[i : i + length].tobytes() for i in distinct]
    assert sorted(kept) == sorted(starts)


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=900), st.integers(1, 4), st.integers(1, 60))
def test_suffix_array_and_common_prefixes(raw, letters, length):
    symbols = np.array([b % letters + 1 for b in raw], np.int64)
    order = suffixes.suffix_array(symbols)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: symbols[i:].tolist())
    shared = suffixes.common_prefixes(symbols, order, length)[order]
    for i, (a, b) in enumerate(zip(order, order[1:]), 1):
        n = 0
        while n < length and max(a, b) + n < len(raw) and symbols[a + n] == symbols[b + n]:
            n += 1
        assert shared[i] == n


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    passage = bytes(rng.randrange(256) for _ in range(300))
    texts = [bytes(rng.randrange(256) for _ in range(rng.randrange(500))) + passage + bytes(rng.randrange(256) for _ in range(90)) for _ in range(5)]
    seen = {}
    for own, hashes, first, count in suffixes.contexts(texts, 200, 32):
        for i, h, f, n in zip(own.tolist(), hashes.tolist(), first.tolist(), count.tolist()):
            for w in range(f, f + n):
                seen.setdefault(texts[i][w : w + 200], []).append(h)
    assert sum(map(len, seen.values())) == sum(len(t) - 199 for t in texts)
    assert all(len(set(found)) == 1 for found in seen.values()) and sum(len(f) == 5 for f in seen.values()) == 101


def test_long_texts_in_blocks(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdef") for _ in range(5000)).encode()
    monkeypatch.setattr(suffixes, "_BLOCK", 256)
    windows = [(i, w) for own, _, first, count in suffixes.contexts([b"x" * 250, text], 200, 32) for i, f, n in zip(own, first, count) for w in range(f, f + n)]
    assert sorted(windows) == [*((0, i) for i in range(51)), *((1, i) for i in range(4801))]


def test_binary_search_over_runs():
    runs = [np.array(r, "S2") for r in ([b"a", b"c", b"e"], [b"b", b"c"], [b"d"], [b"a", b"d", b"f"])]
    assert [m.tolist() for m in suffixes.in_other_runs(runs)] == [[True, True, False], [False, True], [True], [True, True, False]]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def corpus(rng):
    passage, other = prose(rng, 60), prose(rng, 80)
    rows = [(i, prose(rng, rng.randrange(1, 200))) for i in range(60)]
    rows += [(100 + i, prose(rng, 20) + passage + prose(rng, 30)) for i in range(12)]
    rows += [(200 + i, rows[7][1]) for i in range(3)] + [(300, rows[9][1][:-3] + "xyz"), (301, other + " " + other), (302, "la " * 300), (303, rows[8][1] + passage)]
    rows += [(None, "no id " * 60), (None, "no id " * 60), (400, ""), (401, None), (402, "€" * 66), (403, "€" * 66), (404, "€" * 67), (405, "\0" * 250), (406, "\0" * 199)]
    return rows


def test_against_all_windows(spark):
    same(spark, corpus(random.Random(6)))


@pytest.mark.parametrize("shard", [150, 600, 4000])
def test_anchors_split_over_shards(spark, shard):
    """A passage in many texts has more contexts than a small shard holds; one window is shared by two texts alone."""
    rng = random.Random(shard)
    passage = "".join(rng.choice("abc") for _ in range(40))
    rows = [(i, prose(rng, 4)[:23] + passage + prose(rng, 4)[:23]) for i in range(150)]
    rows += [(200, "quite another begin" + passage[:9]), (201, "and quite another begin" + passage[:12])]
    same(spark, rows, 20, 5, shard)


def test_empty_and_short_tables(spark):
    for rows in ([], [(1, "short")], [(1, None)], [(1, "x" * 200)], [(1, "x" * 201)]):
        same(spark, rows)


def test_remove_keeps_whole_code_points_and_other_columns(spark):
    shared = "é" * 120
    odd = documents(spark, [(1, "a" + shared + "b€"), (2, "€" + shared), (3, "alone"), (4, None), (5, "c" * 300), (6, "c" * 300)])
    odd = odd.withColumnRenamed("lang", "raw").withColumnRenamed("source", "spans").withColumnRenamed("n_chars", "k1")
    found = suffixes.remove(odd).collect()
    assert [*found[0].asDict()] == ["doc_id", "text", "raw", "spans", "k1"]
    assert {r.doc_id: r.text for r in found} == {1: "ab€", 2: "€", 3: "alone", 4: None, 5: "", 6: ""}
