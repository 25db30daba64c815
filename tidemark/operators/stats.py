"""Counts and checks over routed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_per_bucket(df: DataFrame) -> DataFrame:
    """Buckets without records have no row."""
    return df.groupBy("bucket_idx", "bucket").agg(F.count("*").alias("n_records"))


def bytes_per_bucket(df: DataFrame) -> DataFrame:
    return df.groupBy("bucket_idx", "bucket").agg(F.count("*").alias("n_records"), F.sum("size").cast("bigint").alias("n_bytes"), F.max("size").alias("longest"))


def count_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_records"))


def split_of(tie: str, rows: int):
    """The split of a record if every split held so many records."""
    return F.floor((F.col(tie) - 1) / rows).cast("bigint")


def max_per_split(df: DataFrame, tie: str, rows: int) -> DataFrame:
    """The most records of a bucket that any split has."""
    counts = df.groupBy("bucket_idx", "bucket", split_of(tie, rows).alias("split")).agg(F.count("*").alias("n"))
    return counts.groupBy("bucket_idx", "bucket").agg(F.max("n").alias("most_records"))


def first_split(df: DataFrame, tie: str, rows: int) -> DataFrame:
    """The first split that has records of a bucket."""
    return df.groupBy("bucket_idx", "bucket").agg(F.min(split_of(tie, rows)).alias("first_split"))


def exchange_matrix(ranked: DataFrame, tie: str, rows: int) -> DataFrame:
    """Records and bytes that each source split sends to each destination shard."""
    to = F.floor((F.col("dest_rank") - 1) / rows).cast("bigint").alias("to_shard")
    return ranked.groupBy(split_of(tie, rows).alias("from_split"), "bucket_idx", to).agg(F.count("*").alias("n_records"), F.sum("size").cast("bigint").alias("n_bytes"))


def sortedness(ranked: DataFrame, rows: int = 100_000) -> DataFrame:
    """Per bucket: records and neighbours by rank whose keys decrease (none, if sorted).

    Neighbours meet in blocks of ranks; the last record of a block is also
    looked at from the next one, so no task holds a bucket.
    """
    block = F.floor((F.col("dest_rank") - 1) / rows)
    own = ranked.select("bucket_idx", "bucket", "dest_rank", "key", block.alias("block"), F.lit(True).alias("own"))
    edges = ranked.filter(F.col("dest_rank") % rows == 0).select("bucket_idx", "bucket", "dest_rank", "key", (block + 1).alias("block"), F.lit(False).alias("own"))
    before = F.lag("key").over(Window.partitionBy("bucket_idx", "block").orderBy("dest_rank"))
    seen = own.unionByName(edges).withColumn("before", before).filter("own")
    return seen.groupBy("bucket_idx", "bucket").agg(F.count("*").alias("n_records"), F.count(F.when(F.col("before") > F.col("key"), 1)).alias("violations"))


def byte_range_splits(df: DataFrame, start: str, header_bytes: int, file_bytes: int, splits: int) -> DataFrame:
    """Records and bytes of each of ``splits`` byte ranges, whose bounds move on to the next line.

    A line belongs to the split after a probe if it begins behind the probe.
    """
    step = (file_bytes) // splits
    number = F.when(F.col(start) > header_bytes, F.least(F.floor((F.col(start) - header_bytes - 1) / step), F.lit(splits - 1))).otherwise(0)
    return df.groupBy(number.cast("bigint").alias("split")).agg(
        F.min(start).cast("bigint").alias("begins"), F.max(F.col(start) + F.col("size")).cast("bigint").alias("ends"), F.count("*").alias("n_records"), F.sum("size").cast("bigint").alias("n_bytes")
    )
