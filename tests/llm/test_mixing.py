import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm import mixing

from helpers import documents


def level(sizes, weights):
    """Targets by sharing the excess again and again."""
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        unit = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * unit > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if s in over else weights[s] * unit
        if not over:
            break
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


def rows_of(seed, n=300):
    rng = random.Random(seed)
    names = ["b", "a", "é", None, "Z", "tiny", "hot"]
    rows = []
    for i in range(n):
        source = rng.choice(names[:5] + ["hot"] * 5)
        rows.append((i, rng.choice([None, "", " "]) if rng.random() < 0.1 else " ".join(["w"] * rng.randrange(1, 60)), source))
    return rows + [(n, "one two", "tiny"), (n + 1, None, "empty")]


@pytest.mark.parametrize("seed", [1, 2])
def test_assignment(spark, seed):
    rows = rows_of(seed)
    found = {r.doc_id: r for r in mixing.assign(documents(spark, rows)).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, taken = level(sizes, weights), Counter()
    for i, _, s in rows:
        r = found[i]
        assert (r["size"], r.source_size, r.weight) == (size[i], sizes[s], weights[s])
        assert math.isclose(r.target, target[s], rel_tol=1e-12)
        assert 0 <= r.taken <= 3 * size[i] and (r.position is None) == (r.taken == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert mixing.assign(documents(spark, [])).count() == 0


def test_sql_agrees(spark, tmp_path):
    df = documents(spark, rows_of(3))
    df.write.parquet(str(tmp_path / "d"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken", "weight", "position"]
    expected = sorted(duck.sql(f"SELECT {', '.join(names)} FROM ({mixing.ASSIGN_SQL})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in mixing.assign(df).collect()) == expected


@pytest.mark.parametrize("rates", [(1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (0.0, 2.0), (1.0, 3.0, 0.5, 2.0)])
def test_positions_invert_the_demand(spark, rates):
    from pyspark.sql import functions as F

    df = spark.range(0, 101).select((F.col("id") / 100).alias("share"))
    pieces = len(rates) - 1

    def spent(t):
        area = 0.0
        for i in range(pieces):
            x = min(max(t * pieces - i, 0), 1)
            area += rates[i] * x + (rates[i + 1] - rates[i]) * x * x / 2
        return area

    for r in df.select("share", mixing.position_at(F.col("share"), rates).alias("t")).collect():
        assert math.isclose(spent(r.t) / spent(1.0), r.share, abs_tol=1e-9)


def test_the_mix(spark):
    rows = rows_of(5) + [(7, "repeated id", "a")]
    df = documents(spark, rows).withColumnsRenamed({"lang": "mix_size", "n_chars": "mix_key"})
    plan = mixing.plan(mixing.sized(df)).collect()
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    out = mixed.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words, wanted = defaultdict(int), defaultdict(int)
    for r in out:
        words[r.doc_id] += count(r.text)
    for r in plan:
        wanted[r.doc_id] += r.mix_taken
    assert words == {i: n for i, n in wanted.items() if n}
    texts = {(r[0], r[1]) for r in rows}
    assert sum((r.doc_id, r.text) not in texts for r in out) <= len({r.source for r in out})  # one cut short for each source
    assert [tuple(r) for r in mixing.mix(df).collect()] == [tuple(r) for r in out]


def test_hash_order_is_by_id(spark):
    first = min(range(50), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    rows = [(i, "a b c", "s") for i in range(50)]
    plan = mixing.plan(mixing.sized(documents(spark, rows))).collect()
    assert [r.doc_id for r in plan if r.mix_begin == 0] == [first]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_that_share_an_id_are_dealt_out(spark, doc_id):
    """A third of all rows has one id or none: no bucket holds more than a small part of them, and targets are met."""
    from pyspark.sql import functions as F

    n = 100_000
    some = F.when(F.col("id") % 3 > 0, F.col("id") + 10).otherwise(F.lit(doc_id)).alias("doc_id")
    docs = spark.range(n).select(some, F.concat(F.lit("w x "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    buckets = mixing.sized(docs).groupBy(F.substring("mix_key", 1, 2 * mixing.BUCKET_DIGITS)).count()
    assert buckets.agg(F.max("count")).first()[0] < n / 300
    copies = spark.range(n).select((F.col("id") + 10).alias("doc_id"), F.lit("w x y").alias("text"), F.lit("t").alias("source"))
    found = mixing.assign(docs.unionByName(copies)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect()
    assert sum(r["size"] for r in found) == 6 * n and all(abs(r.taken - r.target) <= 1 for r in found)
