"""Mixing sources to target weights by a time-varying curriculum.

Targets: the sources, ordered by code point with null last, weigh 1, 2, 3,
repeating, and share the words of the whole corpus by weight.  A target stops
at ``MOST`` times its source's words and the excess is shared again, so every
target is min(MOST * words, level * weight) at the one level that spends all
words.

Schedule: each weight has a rate over the time of training, piecewise linear
between evenly spaced knots.  The rate's integral, scaled to the target, is the
source's cumulative demand.  A source's documents form a stream in the order of
a hash; a document that begins after c words of the stream is needed when the
cumulative demand reaches c, and inverting the integral gives its position
between 0 and 1.  The mix is the documents range-sorted by position.

Streams are prefix sums in two steps, over hash buckets and then inside each
bucket, so that no task sorts a whole source.  Buckets are named by hashes of id
and text, so neither rows that share an id, or have none, nor copies of a text
meet in one bucket; only rows that are equal in both do.

Defined results: a null or empty text has size 0 and takes nothing; a source of
size 0 has target 0; null is a source of its own; rows with equal ids are
ordered by text and size, and rows that are equal in all of these are
interchangeable; no id counts as an empty one; other columns may be present and
are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, cut_small, text_or_empty

MOST = 3
WEIGHTS = (1, 2, 3)
#: Rates at evenly spaced times, for each weight: light sources come early, heavy ones late.
SCHEDULE = {1: (1.5, 1.0, 0.5), 2: (1.0, 1.0, 1.0), 3: (0.5, 1.0, 1.5)}
#: Hex digits of each of the two hashes that name a bucket: at most 65,536 buckets for each source.
BUCKET_DIGITS = 2


def _knots(rates: tuple[float, ...]) -> list[float]:
    """The share of the demand that is spent at each knot."""
    spent = [0.0]
    for a, b in zip(rates, rates[1:]):
        spent.append(spent[-1] + (a + b) / 2)
    return [x / spent[-1] for x in spent]


def position_at(share: Column, rates: tuple[float, ...]) -> Column:
    """The time at which a source has spent ``share`` of its demand."""
    pieces, spent = len(rates) - 1, _knots(rates)
    whole = sum((a + b) / 2 for a, b in zip(rates, rates[1:]))
    found = F.lit(1.0)
    for i in reversed(range(pieces)):
        a, slope = rates[i], rates[i + 1] - rates[i]
        area = (share - spent[i]) * whole  # rate a, changing by slope over the piece: area = a x + slope x^2 / 2
        root = a + F.sqrt(F.greatest(a * a + 2 * slope * area, F.lit(0.0)))
        inside = F.when(area > 0, 2 * area / F.when(root > 0, root)).otherwise(0.0)
        found = F.when(share < spent[i + 1], (i + inside) / pieces).otherwise(found)
    return found


def targets(sources: DataFrame) -> DataFrame:
    """For ``source``, ``source_size`` (one row each): also ``weight`` and ``target``."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = sources.withColumn("weight", cycle)
    # in the order in which sources stop, all before a source have stopped and the others share the rest
    stops = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    after = stops.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sum("source_size").over(Window.partitionBy()) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = rest / F.sum("weight").over(after)
    # a source stops for good at its turn: the level only rises from there
    free = weighed.withColumn("level", level).withColumn("stopped", F.col("weight") * F.col("level") > MOST * F.col("source_size"))
    lowest = F.min(F.when(~F.col("stopped"), F.struct(F.col("source_size") / F.col("weight"), F.col("level").alias("level")))).over(Window.partitionBy())
    least = F.least((MOST * F.col("source_size")).cast("double"), F.col("weight") * lowest["level"])
    return free.withColumn("target", F.coalesce(least, (MOST * F.col("source_size")).cast("double"))).select("source", "source_size", "weight", "target")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the size of each document and its place in a stream's order."""
    by_id = F.md5(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8"))
    by_text = F.md5(F.encode(text_or_empty(text), "UTF-8"))
    return docs.withColumns({
        "mix_size": F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long"),
        "mix_key": F.concat(F.substring(by_id, 1, BUCKET_DIGITS), F.substring(by_text, 1, BUCKET_DIGITS), by_id),
        "mix_tie": F.xxhash64(text),
    })


def _offsets(sums: DataFrame) -> DataFrame:
    """The words of a source before each of its buckets: before the block of the bucket, and before it in the block."""
    blocked = sums.withColumn("block", F.substring("bucket", 1, BUCKET_DIGITS))
    earlier = Window.partitionBy("block_of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(F.col("source").alias("block_of"), F.col("block").alias("at")).agg(F.sum("words").alias("words"))
    blocks = blocks.select("block_of", "at", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = blocked.withColumn("within", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    joined = within.join(blocks, (F.col("block") == F.col("at")) & F.col("source").eqNullSafe(F.col("block_of")))
    return joined.select("source", "bucket", (F.col("before") + F.col("within")).alias("mix_offset"))


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` (from ``sized``) with ``mix_target``, ``mix_source_size``, ``mix_weight``, ``mix_taken``, ``mix_begin``.

    A document is taken whole, as often as its whole source; then documents
    from the start of the stream are taken once more until the target is met,
    the last of them in part.
    """
    rows = docs.withColumn("mix_bucket", F.substring("mix_key", 1, 2 * BUCKET_DIGITS))
    sums = rows.groupBy(F.col(source).alias("source"), F.col("mix_bucket").alias("bucket")).agg(F.sum("mix_size").alias("words"))
    sums = cut_small(sums)
    aims = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    offsets = _offsets(sums)
    aims = aims.select(
        F.col("source").alias("aim"), F.col("source_size").alias("mix_source_size"), F.col("weight").alias("mix_weight"), F.col("target").alias("mix_target")
    )
    aims = offsets.join(aims, F.col("source").eqNullSafe(F.col("aim"))).withColumnsRenamed({"source": "mix_of", "bucket": "mix_in"}).drop("aim")
    placed = rows.join(aims, (F.col("mix_bucket") == F.col("mix_in")) & F.col(source).eqNullSafe(F.col("mix_of")))
    inside = Window.partitionBy("mix_of", "mix_in").orderBy("mix_key", F.col(doc_id), "mix_size", "mix_tie").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("mix_offset") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0))
    goal = F.floor("mix_target").cast("long")
    size, whole = F.col("mix_size"), F.col("mix_source_size")
    times = F.when(whole > 0, F.floor(goal / F.when(whole > 0, whole))).otherwise(0).cast("long")
    placed = placed.withColumn("mix_begin", begin).withColumn("mix_times", times)
    more = F.least(F.greatest(goal - F.col("mix_times") * whole - F.col("mix_begin"), F.lit(0)), size)
    return placed.withColumn("mix_taken", (F.col("mix_times") * size + more).cast("long")).drop("mix_bucket", "mix_in", "mix_of", "mix_offset")


def position(words: Column, target: Column, weight: Column) -> Column:
    """When the word after ``words`` words of the stream is needed."""
    share = words / F.when(target > 0, target)
    found = F.lit(None).cast("double")
    for w, rates in SCHEDULE.items():
        found = F.when(weight == w, position_at(share, rates)).otherwise(found)
    return found


def assign(docs: DataFrame) -> DataFrame:
    """Per document: sizes, target, words taken and the position of its first use, range-sorted by position."""
    small = cut(sized(docs.select("doc_id", "source", "text")).drop("text"))
    first = F.when(F.col("mix_taken") > 0, position(F.col("mix_begin"), F.col("mix_target"), F.col("mix_weight")))
    found = plan(small).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
        F.col("mix_weight").cast("long").alias("weight"),
        F.round(first, 9).alias("position"),
    )
    return found.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def _first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its n-th word."""
    kept = F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), words.cast("int"))
    return F.array_join(kept, "")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each use of a document, range-sorted by position.

    A document that is taken in part keeps its first words.
    """
    packed = docs.select(F.struct("*").alias("doc"))  # so that no name of the table can clash
    own_id, own_text, own_source = (f"doc.`{name}`" for name in (doc_id, text, source))
    planned = plan(sized(packed, own_id, own_text), own_id, own_source).filter("mix_taken > 0")
    uses = F.ceil(F.col("mix_taken") / F.col("mix_size")).cast("int")
    used = planned.select("*", F.explode(F.sequence(F.lit(0), uses - 1)).alias("mix_use"))
    left = F.col("mix_taken") - F.col("mix_use") * F.col("mix_size")
    cut_short = F.when(left < F.col("mix_size"), _first_words(F.col(own_text), left)).otherwise(F.col(own_text))
    at = position(F.col("mix_use") * F.col("mix_source_size") + F.col("mix_begin"), F.col("mix_target"), F.col("mix_weight"))
    placed = used.select("doc", at.alias("mix_position"), cut_short.alias("mix_text")).orderBy("mix_position", own_id)
    return placed.select(*(F.col(f"doc.`{name}`") if name != text else F.col("mix_text").alias(text) for name in docs.columns))


ASSIGN_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, left(h, 2) || left(md5(coalesce(text, '')), 2) || h AS k
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM sums),
turns AS (
  SELECT *, source_size / weight AS turn,
         (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0)) / sum(weight) OVER after AS level
  FROM weighed
  WINDOW before AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
aims AS (
  SELECT source, source_size, weight, least(CAST(3 * source_size AS DOUBLE),
         weight * coalesce((SELECT arg_min(level, turn) FROM turns t WHERE NOT t.weight * t.level > 3 * t.source_size), 1e300)) AS target
  FROM turns),
placed AS (
  SELECT doc_id, size, aims.source_size, target, weight, CAST(floor(target) AS BIGINT) AS goal,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS times,
         coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source),
taken AS (
  SELECT *, times * size + least(greatest(goal - times * source_size - begin, 0), size) AS taken,
         CAST(begin AS DOUBLE) / target AS share
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, CAST(weight AS BIGINT) AS weight,
  round(CASE WHEN taken > 0 THEN CASE weight
    WHEN 1 THEN CASE WHEN share < 0.625 THEN (2 * (share * 2) / (1.5 + sqrt(greatest(2.25 - 1.0 * (share * 2), 0)))) / 2
                     ELSE (1 + 2 * ((share - 0.625) * 2) / (1.0 + sqrt(greatest(1.0 - 1.0 * ((share - 0.625) * 2), 0)))) / 2 END
    WHEN 2 THEN share
    ELSE CASE WHEN share < 0.375 THEN (2 * (share * 2) / (0.5 + sqrt(greatest(0.25 + 1.0 * (share * 2), 0)))) / 2
              ELSE (1 + 2 * ((share - 0.375) * 2) / (1.0 + sqrt(greatest(1.0 + 1.0 * ((share - 0.375) * 2), 0)))) / 2 END
  END END, 9) AS position
FROM taken
"""
