"""Total orders and running sums that no single task computes for a whole bucket.

Records are range-partitioned by (bucket, key, source order), so a bucket, or
even one key of it, may span any number of partitions.  The bounds of the ranges
are explicit: quantiles of a sample that depends on the rows alone, the ``OVER``
rows for each range with the least hashes.  So every pass over the same rows,
and every task that runs again, deals them alike, and running values need no
second shuffle and no checkpoint: one light pass counts rows and bytes of each
range, and in the one shuffle of the rows each range adds what lies before it to
a window inside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORT = ("bucket_idx", "key")
#: Sampled rows for each range.
OVER = 64


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sorts(names: list[str]) -> Column:
    """The columns as one value that sorts as they do."""
    return F.struct(*names)


def range_bounds(df: DataFrame, by: list[str], parts: int) -> list[tuple]:
    """Up to ``parts`` - 1 rows of ``by``, in order: quantiles of the rows with the least hashes, about ``OVER`` for each range."""
    keys = df.select(*by)
    sample = keys.orderBy(F.xxhash64(*by), *by).limit(parts * OVER)  # the least of each task meet on the driver
    rows = [tuple(r) for r in sample.orderBy(*by).collect()]
    chosen = [rows[len(rows) * i // parts] for i in range(1, parts)] if rows else []
    return list(dict.fromkeys(chosen))


def _known(df: DataFrame, by: list[str], bounds: list[tuple]) -> Column:
    kinds = [df.schema[name].dataType for name in by]
    return F.array(*(F.struct(*(F.lit(v).cast(kind).alias(name) for v, kind, name in zip(bound, kinds, by))) for bound in bounds))


def range_of(df: DataFrame, by: list[str], bounds: list[tuple]) -> Column:
    """How many bounds lie at or before a row, by binary search.

    One expression, whose steps Spark interprets; ``with_range`` compiles them.
    """
    if not bounds:
        return F.lit(0)
    known = _known(df, by, bounds)
    begin = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(now: Column, _: Column) -> Column:
        low, high = now["low"], now["high"]
        middle = F.floor((low + high) / 2).cast("int")
        after = F.get(known, middle) <= _sorts(by)
        return F.when(low >= high, now).otherwise(F.struct(F.when(after, middle + 1).otherwise(low).alias("low"), F.when(after, high).otherwise(middle).alias("high")))

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(bounds) + 1))))
    return F.aggregate(steps, begin, halve, lambda now: now["low"])


def with_range(df: DataFrame, by: list[str], bounds: list[tuple], name: str = "run_part") -> DataFrame:
    """``df`` with the column of ``range_of``, a projection for each step of the search; the value that a row sorts by is made once."""
    found = df.withColumn(name, F.lit(0))
    if not bounds:
        return found
    known, found = _known(df, by, bounds), found.withColumn("run_key", _sorts(by))
    step = 1 << (len(bounds).bit_length() - 1)
    while step:  # a step beyond the last bound meets null, and isn't taken
        found = found.withColumn(name, F.col(name) + F.when(F.get(known, F.col(name) + (step - 1)) <= F.col("run_key"), step).otherwise(0))
        step >>= 1
    return found.drop("run_key")


def _ranged(df: DataFrame, by: list[str], parts: int) -> DataFrame:
    """``df`` with ``run_part``, the range of each row."""
    return with_range(df, by, range_bounds(df, by, parts))


def total_order(df: DataFrame, *tie: str, partitions: int | None = None) -> DataFrame:
    """``df`` partitioned by ranges of bucket, key and source order (``src_offset``, or the columns ``tie``), whose number is ``run_part``, and sorted."""
    by, parts = [*SORT, *(tie or ("src_offset",))], partitions or partitions_of(df)
    return _ranged(df, by, parts).repartitionById(parts, "run_part").sortWithinPartitions(*by)


def running(df: DataFrame, group: list[str], by: list[str], size: str, rank: str = "dest_rank", end: str = "dest_end", partitions: int | None = None) -> DataFrame:
    """``df`` with the 1-based rank and the inclusive running sum of ``size`` in each group, in the order ``by``.

    ``by`` must be unique within a group.  ``df`` is read three times, of which
    one moves its rows, so what is dear to compute should be in a table before.
    Groups are the buckets of a header: the driver holds their names, and so
    may each executor hold a row for each of them and each range.
    """
    columns, parts = df.columns, partitions or partitions_of(df)
    ranged = _ranged(df, [*group, *by], parts)
    sums = ranged.groupBy(*group, "run_part").agg(F.count("*").alias("run_rows"), F.sum(size).alias("run_bytes"))
    earlier = Window.partitionBy(*group).orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        *(F.col(g).alias(f"run_{g}") for g in group),
        F.col("run_part").alias("run_of"),
        F.coalesce(F.sum("run_rows").over(earlier), F.lit(0)).alias("run_rank"),
        F.coalesce(F.sum("run_bytes").over(earlier), F.lit(0)).alias("run_end"),
    )
    same = F.col("run_part") == F.col("run_of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"run_{g}"))
    inside = Window.partitionBy("run_part", *group).orderBy(*by)
    through = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.repartitionById(parts, "run_part").select("*", F.row_number().over(inside).alias("run_row"), F.sum(size).over(through).alias("run_sum"))
    # a row for each range, and one more for each group that begins inside a range
    joined = placed.join(F.broadcast(before), same)
    return joined.select(*columns, (F.col("run_rank") + F.col("run_row")).cast("bigint").alias(rank), (F.col("run_end") + F.col("run_sum")).cast("bigint").alias(end))


def dest_ranks(df: DataFrame, *tie: str, size: str = "size") -> DataFrame:
    """Routed records with their rank and last byte in the file of their bucket; ``tie`` has the source order of a bucket's equal keys."""
    return running(df, ["bucket_idx"], ["key", *(tie or ("src_ord",))], size)


def shard_offsets(ranked: DataFrame, rows: int) -> DataFrame:
    """Shards of ``rows`` ranks each: their rows, bytes and the byte before them in their bucket's file."""
    shards = ranked.groupBy("bucket_idx", "bucket", F.floor((F.col("dest_rank") - 1) / rows).cast("bigint").alias("shard"))
    shards = shards.agg(F.count("*").alias("shard_rows"), F.sum("size").cast("bigint").alias("shard_bytes"))
    earlier = Window.partitionBy("bucket_idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("shard_offset", F.coalesce(F.sum("shard_bytes").over(earlier), F.lit(0)).cast("bigint"))
