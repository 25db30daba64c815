"""Quality rules, with cross-document line frequency by host.

Each text gets its own counts.  Beyond them every line is normalised (letters
only, lower case), hashed, and counted over the distinct documents of its host;
a line found in more than ``MOST_DOCUMENTS`` of them is boilerplate and is
removed, and a document that has too little left is rejected.  Documents of a
host with equal texts count once, so copies alone don't make their lines
boilerplate.  The host is the ``source`` column.

Defined results: a null or empty text has no words and fails the base rules;
lines without letters are never boilerplate; a null host is a host of its own;
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import WORD, bound_batches, cut, text_or_empty

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A line in more distinct documents of a host than this is removed.
MOST_DOCUMENTS = 10
#: A document is depleted with fewer words than this left, or a smaller share of its words.
LEAST_WORDS = 5
LEAST_SHARE = 0.3

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANKS = " \t\n\v\f\r"


def _repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of ``WINDOW`` words that the text has twice or more."""
    windows = len(words) - WINDOW + 1
    if windows < 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    factors = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, np.uint64) | np.uint64(1)
    mixed = np.zeros(windows, np.uint64)
    for i in range(WINDOW):
        mixed += codes[i : i + windows] * factors[i]
    _, at, times = np.unique(mixed, return_inverse=True, return_counts=True)
    likely = np.flatnonzero(times[at] > 1)  # equal windows have equal sums; the reverse is verified
    if not len(likely):
        return 0
    rows = codes[likely[:, None] + np.arange(WINDOW)]
    _, at, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    found = likely[times[at.ravel()] > 1]
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, found, 1)
    np.add.at(steps, found + WINDOW, -1)
    return int((np.cumsum(steps) > 0).sum())


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    chars = len(text) - sum(map(text.count, _BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated_words(words)


@F.pandas_udf(StructType([StructField(name, LongType()) for name in _COUNTS]))
def _counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts_of(t) for t in texts], columns=_COUNTS, dtype="int64")


def _lines(text: Column) -> Column:
    """The lines that have letters, as (hash of the normal form, words)."""
    hashed = F.transform(
        F.split(text, "\n", -1),
        lambda line: F.struct(
            F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]++", " ")).alias("normal"), F.regexp_count(line, F.lit(WORD)).alias("words")
        ),
    )
    lettered = F.filter(hashed, lambda x: F.length(x["normal"]) > 0)
    return F.transform(lettered, lambda x: F.struct(F.xxhash64(x["normal"]).alias("line"), x["words"].alias("words")))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: the counts, ``base_failed``, ``kept``, and the lines and words that were removed."""
    bound_batches(docs.sparkSession)
    rows = cut(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.col(host).alias("host"),
            F.xxhash64(text).alias("same"),
            _lines(text_or_empty(text)).alias("lines"),
            _counts(F.col(text)).alias("counts"),
        )
    )
    texts = rows.dropDuplicates(["host", "same"])
    once = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    common = once.groupBy("host", "line").agg(F.count("*").alias("documents")).filter(F.col("documents") > MOST_DOCUMENTS)
    common = common.select(F.col("host").alias("common_host"), F.col("line").alias("common_line"))
    placed = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words")
    removed = (
        placed.join(common, (F.col("line") == F.col("common_line")) & F.col("host").eqNullSafe(F.col("common_host")), "left_semi")
        .groupBy("row")
        .agg(F.count("*").alias("removed_lines"), F.sum("words").cast("long").alias("removed_words"))
    )
    joined = rows.select("row", "doc_id", "counts.*").join(removed, "row", "left").na.fill(0, ["removed_lines", "removed_words"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < LEAST_WORDS) | (left < LEAST_SHARE * F.col("n_words"))
    return joined.select("doc_id", *_COUNTS, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_lines", "removed_words")


JUDGE_SQL = rf"""
WITH bodies AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, source AS host, text, coalesce(text, '') AS body FROM documents),
worded AS MATERIALIZED (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM bodies),
windows AS (SELECT id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w FROM worded, unnest(range(1, len(words) - {WINDOW - 2})) t(i)),
twice AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, w) > 1),
covered AS (SELECT id, count(DISTINCT j) AS n FROM twice, unnest(range(i, i + {WINDOW})) t(j) GROUP BY id),
placed AS MATERIALIZED (SELECT id, host, text, trim(regexp_replace(lower(line), '[^\p{{L}}]+', ' ', 'g')) AS normal,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM worded, unnest(string_split(body, chr(10))) t(line)),
common AS (SELECT host, normal FROM (SELECT DISTINCT host, text, normal FROM placed WHERE normal <> '') GROUP BY ALL HAVING count(*) > {MOST_DOCUMENTS}),
removed AS (SELECT id, count(*) AS lines, sum(n) AS words FROM placed p
  WHERE EXISTS (SELECT 1 FROM common c WHERE c.normal = p.normal AND c.host IS NOT DISTINCT FROM p.host) GROUP BY id),
counted AS (SELECT doc_id, CAST(len(worded.words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(worded.words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(worded.lines) - len(list_distinct(worded.lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed.lines, 0) AS BIGINT) AS removed_lines, CAST(coalesce(removed.words, 0) AS BIGINT) AS removed_words
  FROM worded LEFT JOIN covered USING (id) LEFT JOIN removed USING (id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND NOT (n_words - removed_words < {LEAST_WORDS} OR n_words - removed_words < {LEAST_SHARE} * n_words) AS kept FROM failed
"""
