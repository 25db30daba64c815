import random
import re

import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components

from helpers import documents, union_find


def brute_fingerprint(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \n", "One", "one two", "A b C d", "a b c " * 500, "é è x y z", "x" * 100_000, "a\x0bb\x0cc d"):
        assert simhash.fingerprint_of(text) == brute_fingerprint(text)


def test_a_text_of_many_stretches(monkeypatch):
    monkeypatch.setattr(simhash, "_STRETCH", 7)
    for text in ("a b c d e f g h i j", "one  two\n\n three ", "x" * 30, "x" * 30 + " y", " " * 40, "ab " * 9 + "x" * 20 + " yz" * 9):
        assert simhash.fingerprint_of(text) == brute_fingerprint(text)


def test_links_are_all_within_two_bits(spark):
    rng = random.Random(1)
    values = {0, (1 << 64) - 1, 1, 3, 7, 1 << 63, (1 << 63) | 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(rng.randrange(6)):  # chains of near values
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
            values.add(base)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    found = {(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in simhash.links(df).collect()}
    assert all(bin(u ^ v).count("1") <= 2 for u, v in found)
    linked = union_find(values, found)
    expected = union_find(values, [(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 2])
    assert {v: {w for w in values if linked[w] == linked[v]} for v in values} == {v: {w for w in values if expected[w] == expected[v]} for v in values}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, 201), (201, 200), (300, 300), (400, 399)] + [(1000, rng.randrange(1000, 1100)) for _ in range(80)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    nodes = {x for e in edges for x in e}
    assert found == union_find(nodes, edges)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(4000))
    rows = [(5, long), (3, long + " end"), (9, long.upper()), (7, "other words entirely here"), (8, None), (2, ""), (2, " "), (None, "other words entirely here"), (11, "other words entirely here")]
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    for row, (i, fp) in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.fingerprint)), sorted(fps, key=lambda x: (x[0] is None, x[0] or 0, f"{x[1]:016x}"))):
        near = {fp}
        while more := {g for _, g in fps if g not in near and any(bin(g ^ n).count("1") <= 2 for n in near)}:
            near |= more
        assert (row.doc_id, row.fingerprint) == (i, f"{fp:016x}")
        assert row.component_id == min(j for j, g in fps if g in near and j is not None)


def test_one_of_each_group_stays(spark):
    rows = [(4, "same text of several words"), (2, "same text of several words"), (2, "same text of several words"), (6, "quite different content appears here"), (None, "quite different content appears here")]
    df = documents(spark, rows).withColumnsRenamed({"lang": "fp", "n_chars": "key", "source": "kept_id"})
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 6]
    assert simhash.keep_one(documents(spark, [])).count() == 0
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_rows_that_repeat_or_lack_an_id_stay_by_their_group(spark):
    near, alone = "One text of several words", "quite different content appears here"
    others = ["a third thing that nobody wrote before", "some fourth matter of its own sort"]
    rows = [(5, near), (7, near.upper()), (7, alone), *((None, t) for t in others), (None, others[0]), (None, others[0].upper()), (None, near)]
    kept = {(r.doc_id, r.text.lower()) for r in simhash.keep_one(documents(spark, rows)).collect()}
    assert simhash.keep_one(documents(spark, rows)).count() == 4
    assert kept == {(5, near.lower()), (7, alone), *((None, t) for t in others)}
