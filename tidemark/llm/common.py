"""What several operators share: reading tables, cutting lineage, word rules."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.lineage import checkpoint_folder  # noqa: F401
from tidemark.lineage import settle as cut  # noqa: F401

#: A word is a run of characters other than these six (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Hand texts to Python workers in batches of so many rows and bytes at most, to bound a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """At the end of a task: memory that its Python worker would else keep for whatever stage uses it next."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def cut_small(df: DataFrame) -> DataFrame:
    """``cut`` for what an aggregation has left: about a file for each core, not one for each shuffle partition.

    A task reads its partitions one after the other, so none holds more for it.
    Each file costs local file systems a process or two, for its permissions.
    """
    spark = df.sparkSession
    return cut(df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)))


#: What may be broadcast, as counted before: rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 1 << 24


def small(df: DataFrame) -> DataFrame:
    """``df`` (settled, as it is counted) with a hint to broadcast it if it has few rows and bytes."""
    octets = sum((F.octet_length(F.col(name).cast("string")) for name in df.columns), F.lit(0))
    size = df.agg(F.count("*").alias("rows"), F.sum(octets).alias("octets")).first()
    return F.broadcast(df) if size.rows <= BROADCAST_ROWS and (size.octets or 0) <= BROADCAST_BYTES else df


def in_training(doc_id: Column | str, folds: int, held_out: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, isn't ``held_out``.

    A row without an id has no remainder; it counts as held out.
    """
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    remainder = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds
    return F.coalesce(remainder != held_out, F.lit(False))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)
