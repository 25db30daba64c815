import math
import random
import re
import zlib

from tidemark.llm import toxicity

from helpers import documents

RUDE = ["idiot", "moron", "trash", "scum"]


def labelled(spark, n=900, seed=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        for _ in range(4 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["you", rng.choice(RUDE)]) + rng.choice(["", "!", "."]))
            text.insert(rng.randrange(len(text)), rng.choice(RUDE))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), {i: t for i, _, t in labels}


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    rows = toxicity.digest(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels, truth = labelled(spark, 400)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r.doc_id: r.score for r in toxicity.digest(docs, x).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_rejection_keeps_columns(spark):
    docs, labels, truth = labelled(spark, 600)
    df = docs.withColumnsRenamed({"lang": "score", "source": "tox_raw", "n_chars": "doc"})
    kept = toxicity.reject(df, labels)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & {i for i, t in truth.items() if t}) <= 0.1 * sum(truth.values())
    assert len(ids & {i for i, t in truth.items() if not t}) >= 0.98 * sum(1 - t for t in truth.values())


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = toxicity.digest(documents(spark, [(1, None), (1, ""), (None, "x " * 50_000)]), none).collect()
    assert [r.score for r in rows] == [0.0] * 3 and all(r.predicted == 0 for r in rows)
    one = spark.createDataFrame([(i, 1, 1) for i in range(40)] + [(0, 1, None)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.digest(documents(spark, [(i, "a b") for i in range(40)]), one).collect()} == {1.0}
    assert toxicity.digest(documents(spark, []), one).count() == 0


def test_features():
    features = toxicity.Features({"idiot": 5.0, "idi": 2.5})
    rows = dict(zip((0, 1, 2, 3), features.of(["You IDIOT!!", "1d1ot is odd", None, "plain words"])))
    at = features.NAMES.index
    assert rows[0][at("near_second")] == 1.0 and rows[0][at("caps_rate")] == 0.5 and rows[0][at("most_weight")] == 5.0
    assert rows[1][at("undone_rate")] > 0 and rows[2] == [0.0] * len(features.NAMES) and rows[3][at("hit_density")] == 0


def brute_features(text, lexicon):
    """The features by their definition, word by word."""
    tokens = (text or "").split()
    if not tokens:
        return [0.0] * len(toxicity.Features.NAMES)
    weigh = lambda w: max([lexicon.get(w, 0.0)] + [lexicon.get(w[:k], 0.0) for k in range(3, 8) if k < len(w)])
    facts = []
    for t in tokens:
        word = t.lower().strip(".,;:!?\"'()[]{}|-_`~<>/\\")
        odd = bool(re.search(r"[^\W\d_][\d@$!*]+[^\W\d_]", word))
        stretched = bool(re.search(r"([^\W\d_])\1\1", word))
        undone = max(weigh(word.translate(str.maketrans("013457@$!*", "oieastasi."))), weigh(re.sub(r"(.)\1+", r"\1", word))) if odd or stretched else 0.0
        letters = [c for c in t if c.isalpha()]
        facts.append({"weight": max(weigh(word), undone), "second": word in toxicity._SECOND, "caps": len(letters) > 1 and all(c.isupper() for c in letters), "odd": odd, "undone": undone > 0, "stretched": stretched})
    n, chars = len(tokens), "".join(tokens)
    hits = [i for i, f in enumerate(facts) if f["weight"] > 0]
    second = [i for i, f in enumerate(facts) if f["second"]]
    share = lambda name: sum(f[name] for f in facts) / n
    return [
        share("weight"), len(hits) / n, sum(f["weight"] >= 2 * toxicity.LEAST_ODDS for f in facts) / n, max(f["weight"] for f in facts), math.log1p(len({tokens[i] for i in hits})),
        sum(any(abs(i - j) <= toxicity.NEAR_WORDS for j in second) for i in hits) / len(hits) if hits and second else 0.0, len(second) / n,
        share("caps"), sum(c.isupper() for c in chars) / max(sum(c.isalpha() for c in chars), 1), sum(not c.isalnum() for c in chars) / len(chars),
        sum(c in "!?" for c in chars) / len(chars), share("odd"), share("undone"), share("stretched"), math.log1p(n),
    ]


def test_features_by_brute_force():
    rng = random.Random(9)
    lexicon = {"idiot": 5.0, "idi": 2.5, "trash": 3.0, "mor": 2.1, "scum": 4.4}
    words = ["you", "YOUR,", "u", "IDIOT!!", "1d1ot", "idiiiot", "trash", "tr@sh?", "moronic", "scum.", "plain", "Word", "NASA", "l33t", "(du)", "été", "'", "--", "sooo", "a", "x1y"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", "\n\t", "\u00a0 x"]
    for text, row in zip(texts, toxicity.Features(lexicon).of(texts), strict=True):
        assert all(math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-9) for a, b in zip(row, brute_features(text, lexicon), strict=True)), text


def pooled(points):
    """Isotonic regression by pooling neighbours that decrease."""
    blocks = []
    for y, w in points:
        blocks.append([y * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, weight, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + weight, blocks[-1][2] + n]
    return [t / w for t, w, n in blocks for _ in range(n)]


def test_calibration_by_brute_force(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    docs, labels, truth = labelled(spark, 500, 5)
    model = toxicity.fit(docs, labels)
    raw = model.trees.transform(toxicity.with_features(docs, model.words)).select("doc_id", F.get(vector_to_array("tox_probability"), 1).alias("p")).collect()
    by_value = {}
    for r in raw:
        if zlib.crc32(str(r.doc_id).encode()) % 5 == toxicity.CALIBRATION_FOLD:
            by_value.setdefault(r.p, []).append(truth[r.doc_id])
    values = sorted(by_value)
    expected = dict(zip(values, pooled([(sum(by_value[v]) / len(by_value[v]), len(by_value[v])) for v in values])))
    scores = {r.doc_id: r.score for r in model.score(docs).collect()}
    seen = [(expected[r.p], scores[r.doc_id]) for r in raw if r.p in expected]
    assert len(seen) > 50 and all(math.isclose(a, b, abs_tol=1e-9) for a, b in seen)


def test_ids_that_repeat_are_bounded(spark, monkeypatch):
    """Rows of one labelled id that the documents repeat are a weight; beyond the bound, texts are chosen by a hash."""
    from pyspark.sql import functions as F

    docs, labels, truth = labelled(spark, 300)
    hot = next(i for i in truth if zlib.crc32(str(i).encode()) % 5 == toxicity.CALIBRATION_FOLD)
    labels = labels.select(F.col("doc_id").alias("labelled_id"), "toxic").distinct()
    pairs = docs.select(F.col("doc_id").alias("labelled_id"), "text")
    copies = spark.range(100_000).select(F.lit(hot).cast("bigint").alias("labelled_id"), F.lit("a b").alias("text"))
    monkeypatch.setattr(toxicity, "SAMPLE", 1000)
    rows = toxicity._labelled(pairs.unionByName(copies), labels).collect()
    assert len(rows) == 301 and sum(r.weight for r in rows) == 100_300 and max(r.weight for r in rows) == 100_000
    different = copies.withColumn("text", F.concat(F.lit("a b "), F.monotonically_increasing_id().cast("string")))
    rows = toxicity._labelled(pairs.unionByName(different), labels)
    assert 700 < rows.count() < 1300 and sorted(map(tuple, rows.collect())) == sorted(map(tuple, rows.repartition(7).collect()))


def test_weights_are_rows(spark):
    docs, labels, truth = labelled(spark, 400)
    from pyspark.sql import functions as F

    words = toxicity.lexicon(docs.join(labels, "doc_id").select("toxic", "text", F.lit(3).alias("weight")))
    thrice = docs.unionByName(docs).unionByName(docs).join(labels, "doc_id").select("toxic", "text", F.lit(1).alias("weight"))
    assert words and words == toxicity.lexicon(thrice)


def test_features_do_not_depend_on_slices(monkeypatch):
    texts = ["You idiot", None, "", "a b c " * 50, "st00pid PEOPLE!!", "x" * 300, "your ideas"] * 5
    whole = toxicity.Features({"idiot": 4.5, "stupid": 3.0}).of(texts)
    monkeypatch.setattr(toxicity, "_SLICE", 100)
    monkeypatch.setattr(toxicity, "_KEPT_TOKENS", 4)
    small = toxicity.Features({"idiot": 4.5, "stupid": 3.0})
    assert small.of(texts) == whole and len(small.tokens) < 12
