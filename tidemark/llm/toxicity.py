"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The labelled rows outside the held-out fold are split three ways: two folds
give a lexicon, the next trains the trees, the last calibrates their scores, so
that none of the three sees its own evidence.  The lexicon holds words and word
beginnings that stand in far more toxic than other documents, by log-odds.
Features are densities and rates only: lexicon density and strength, closeness
of lexicon words to second-person words, capitals, punctuation, and obfuscation
(words that mix letters with digits or symbols, and what they say once undone).

About ``SAMPLE`` labelled ids are used at most, chosen by a hash, and of these
about ``SAMPLE`` different pairs of id and text, chosen likewise; pairs that
repeat are one row with a weight.  This bounds what is broadcast and the fit,
whatever ids the documents repeat.  Scores are computed for all whole texts.

Defined results: a null or empty text has features of zero and gets a score
like any other; of several labels of an id the largest counts, null labels are
left out; repeated rows give repeated results; if the training fold lacks one
of the classes, every score is the share of toxic rows (0 without rows); if the
calibration fold does, scores are the trees' probabilities; other columns are
kept by ``reject``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from tidemark.llm.common import bound_batches, cut, cut_small, give_back, in_training

FOLDS, HELD_OUT = 5, 0
LEXICON_FOLDS, TREE_FOLD, CALIBRATION_FOLD = (1, 2), 3, 4
SAMPLE = 100_000
#: Lexicon: length of word beginnings, least log-odds, least evidence (hits times log-odds), most entries.
BEGINNINGS = range(3, 8)
LEAST_ODDS, LEAST_EVIDENCE, LEXICON_SIZE = 2.0, 15.0, 1000
NEAR_WORDS = 5
TREES, DEPTH, STEP = 20, 4, 0.2

_SECOND = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split()
)
_UNDO = str.maketrans("013457@$!*", "oieastasi.")
_EDGES = ".,;:!?\"'()[]{}|-_`~<>/\\"
#: Tokens that a task keeps the facts of; beyond that it starts anew.
_KEPT_TOKENS = 1 << 17
#: A slice of texts, whose new tokens get their facts at once, ends with the text that takes it to this many characters.
_SLICE = 1 << 19


def plain(token: str) -> str:
    return token.lower().strip(_EDGES)


@F.pandas_udf(ArrayType(StringType()))
def _plain_words(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted({plain(t) for t in (text or "").split()} - {""}) for text in texts], dtype=object)


def lexicon(labelled: DataFrame) -> dict[str, float]:
    """Words and word beginnings with their log-odds, from ``text``, ``toxic`` and ``weight``; at most ``LEXICON_SIZE``."""
    words = labelled.select("toxic", "weight", F.explode(_plain_words("text")).alias("word"))
    words = words.groupBy("word").agg(F.sum(F.col("toxic") * F.col("weight")).alias("t"), F.sum("weight").alias("n"))
    parts = F.array_distinct(F.concat(F.array("word"), *(F.when(F.length("word") > k, F.array(F.substring("word", 1, k))).otherwise(F.array().cast("array<string>")) for k in BEGINNINGS)))
    terms = cut_small(words.select(F.explode(parts).alias("term"), "t", "n").groupBy("term").agg(F.sum("t").alias("t"), F.sum(F.col("n") - F.col("t")).alias("c")).filter("t > 0 or length(term) > 2"))
    whole = words.agg(F.sum("t").alias("t"), F.sum(F.col("n") - F.col("t")).alias("c")).first()
    if not whole.t or not whole.c:
        return {}
    odds = F.log((F.col("t") + 0.5) / float(whole.t)) - F.log((F.col("c") + 0.5) / float(whole.c))
    strong = terms.filter("t > 0").withColumn("odds", odds).filter((F.col("odds") >= LEAST_ODDS) & (F.col("odds") * F.col("t") >= LEAST_EVIDENCE))
    best = strong.orderBy((F.col("odds") * F.col("t")).desc(), "term").limit(LEXICON_SIZE)
    return {r.term: r.odds for r in best.collect()}


class _Tokens(dict):
    """Numbers tokens; ``rows`` has the facts of those that are new."""

    FACTS = ("weight", "hit", "strong", "second", "caps", "upper", "letters", "punct", "calls", "odd", "undone", "stretched", "length")

    def __init__(self, words: dict[str, float]):
        super().__init__()
        self.lexicon, self.rows = words, []

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self)
        self.rows.append(self._facts(token))
        return number

    def _weight(self, word: str) -> float:
        return max([self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:k], 0.0) for k in BEGINNINGS if k < len(word))])

    def _facts(self, token: str) -> tuple:
        word = plain(token)
        weight = self._weight(word)
        letters, upper = sum(map(str.isalpha, token)), sum(map(str.isupper, token))
        odd = bool(re.search(r"[^\W\d_][\d@$!*]+[^\W\d_]", word))
        stretched = bool(re.search(r"([^\W\d_])\1\1", word))
        undone = max(self._weight(word.translate(_UNDO)), self._weight(re.sub(r"(.)\1+", r"\1", word))) if odd or stretched else 0.0
        punct = sum(not c.isalnum() for c in token)
        return (
            max(weight, undone), max(weight, undone) > 0, max(weight, undone) >= 2 * LEAST_ODDS, word in _SECOND, letters > 1 and upper == letters,
            upper, letters, punct, token.count("!") + token.count("?"), odd, undone > 0, stretched, len(token),
        )


class Features:
    """Dense features of texts under a lexicon."""

    NAMES = (
        "weight_density", "hit_density", "strong_density", "most_weight", "distinct_hits", "near_second", "second_density",
        "caps_rate", "upper_rate", "punct_rate", "call_rate", "odd_rate", "undone_rate", "stretched_rate", "words",
    )

    def __init__(self, words: dict[str, float]):
        self.words = words
        self._forget()

    def _forget(self) -> None:
        self.tokens, self.facts = _Tokens(self.words), np.zeros((0, len(_Tokens.FACTS)), np.float32)

    def of(self, texts: list[str | None]) -> list[list[float]]:
        found, at = [], 0
        while at < len(texts):
            begin, chars = at, 0
            while at < len(texts) and chars < _SLICE:
                chars += len(texts[at] or "")
                at += 1
            found += self._of_slice(texts[begin:at])
        return found

    def _of_slice(self, texts: list[str | None]) -> list[list[float]]:
        if len(self.tokens) > _KEPT_TOKENS:
            self._forget()
        number = self.tokens.__getitem__
        codes = [np.fromiter(map(number, (t or "").split()), np.int32) for t in texts]
        self.facts = np.concatenate([self.facts, np.array(self.tokens.rows, np.float32).reshape(-1, len(_Tokens.FACTS))])
        self.tokens.rows.clear()
        return [self._row(c) for c in codes]

    def _row(self, codes: np.ndarray) -> list[float]:
        n = len(codes)
        if not n:
            return [0.0] * len(self.NAMES)
        facts = self.facts[codes]
        total = dict(zip(_Tokens.FACTS, facts.sum(axis=0, dtype=float).tolist()))
        hits, second = np.flatnonzero(facts[:, 1]), np.flatnonzero(facts[:, 3])
        near = 0.0
        if len(hits) and len(second):
            after = np.searchsorted(second, hits)
            gaps = np.minimum(np.abs(hits - second[np.minimum(after, len(second) - 1)]), np.abs(hits - second[np.maximum(after - 1, 0)]))
            near = float((gaps <= NEAR_WORDS).mean())
        letters, length = max(total["letters"], 1), max(total["length"], 1)
        return [
            total["weight"] / n, total["hit"] / n, total["strong"] / n, float(facts[:, 0].max()), float(np.log1p(len(np.unique(codes[hits])))), near, total["second"] / n,
            total["caps"] / n, total["upper"] / letters, total["punct"] / length, total["calls"] / length, total["odd"] / n, total["undone"] / n, total["stretched"] / n, float(np.log1p(n)),
        ]


def with_features(docs: DataFrame, words: dict[str, float], text: str = "text", to: str = "tox_features") -> DataFrame:
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(words)  # LEXICON_SIZE entries at most

    @F.pandas_udf(ArrayType(DoubleType()))
    def dense(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(shared.value)
        for texts in batches:
            yield pd.Series(features.of(texts.tolist()), dtype=object)
        del features
        give_back()

    return docs.withColumn(to, array_to_vector(dense(F.col(text))))


class Model:
    """A lexicon, trees and a calibration; ``score`` adds ``score`` and ``predicted``."""

    def __init__(self, words, trees, calibration, share: float):
        self.words, self.trees, self.calibration, self.share = words, trees, calibration, share

    def score(self, docs: DataFrame, text: str = "text", to: str = "score") -> DataFrame:
        if self.trees is None:
            return docs.withColumn(to, F.lit(self.share))
        packed = docs.select(F.struct("*").alias("doc"))  # so that no name of the table can clash
        judged = self.trees.transform(with_features(packed, self.words, f"doc.`{text}`")).select("doc", F.get(vector_to_array("tox_probability"), 1).alias("tox_raw"))
        if self.calibration is None:
            return judged.select("doc.*", F.col("tox_raw").alias(to))
        return self.calibration.transform(judged).select("doc.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "tox_score")).alias(to))


def _classes(rows: DataFrame) -> tuple[int, int]:
    found = rows.agg(F.sum("weight").alias("n"), F.sum(F.col("toxic") * F.col("weight")).alias("t")).first()
    return found.n or 0, int(found.t or 0)


def _chosen(column: str, share: float):
    """Rows by a hash of a column or expression: about ``share`` of its values, with all rows of each."""
    return F.pmod(F.expr(f"xxhash64({column})"), F.lit(1 << 30)) < int((1 << 30) * share)


def _labelled(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Different ``labelled_id`` and ``text`` with ``toxic`` and ``weight``, the number of rows; about ``SAMPLE`` at most."""
    known = F.broadcast(sample)  # SAMPLE ids, about
    rows = docs.join(known, "labelled_id")
    if docs.select("labelled_id").join(known, "labelled_id").count() > 2 * SAMPLE:
        different = rows.agg(F.approx_count_distinct(F.xxhash64("labelled_id", "text"), 0.02).alias("n")).first().n
        if different > SAMPLE:
            rows = rows.filter(_chosen("labelled_id, text", SAMPLE / different))
    return rows.groupBy("labelled_id", "text", "toxic").agg(F.count("*").alias("weight"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the rows of ``labels`` (``doc_id`` and ``label``) outside the held-out fold."""
    usable = labels.filter(F.col(label).isNotNull() & in_training("doc_id", FOLDS, HELD_OUT))
    usable = usable.groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max(label).cast("int").alias("toxic"))
    usable = cut_small(usable)
    there = usable.count()
    sample = usable if there <= SAMPLE else usable.filter(_chosen("labelled_id", SAMPLE / there))
    rows = _labelled(docs.select(F.col(doc_id).alias("labelled_id"), F.col(text).alias("text")), sample)
    rows = rows.withColumn("fold", F.crc32(F.encode(F.col("labelled_id").cast("string"), "UTF-8")) % FOLDS)
    words = lexicon(rows.filter(F.col("fold").isin(*LEXICON_FOLDS)))
    ready = with_features(rows.filter(F.col("fold").isin(TREE_FOLD, CALIBRATION_FOLD)), words).select("fold", "toxic", "weight", "tox_features")
    ready = cut(ready)  # SAMPLE rows, about
    training, calibrating = ready.filter(F.col("fold") == TREE_FOLD), ready.filter(F.col("fold") == CALIBRATION_FOLD)
    n, toxic = _classes(training)
    if not 0 < toxic < n:
        return Model(words, None, None, toxic / n if n else 0.0)
    boosting = GBTClassifier(featuresCol="tox_features", labelCol="toxic", predictionCol="tox_prediction", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=8)
    boosting.setRawPredictionCol("tox_raw_prediction").setProbabilityCol("tox_probability").setWeightCol("weight")
    trees = boosting.fit(training.coalesce(4))
    n, toxic = _classes(calibrating)
    if not 0 < toxic < n:
        return Model(words, trees, None, 0.0)
    raw = trees.transform(calibrating).select(F.get(vector_to_array("tox_probability"), 1).alias("tox_raw"), F.col("toxic").cast("double").alias("toxic"), F.col("weight").cast("double").alias("weight"))
    calibration = IsotonicRegression(featuresCol="tox_raw", labelCol="toxic", weightCol="weight", predictionCol="tox_score").fit(raw)
    return Model(words, trees, calibration, 0.0)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it is held out, its score and the predicted label."""
    docs = docs.select("doc_id", "text")
    scored = fit(docs, labels).score(docs)
    return scored.select("doc_id", (~in_training("doc_id", FOLDS, HELD_OUT)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that are predicted to be toxic."""
    to = "score"
    while to in docs.columns:
        to += "_"
    return fit(docs, labels, doc_id, text).score(docs, text, to).filter(F.col(to) < 0.5).drop(to)
