"""Digests of files that don't depend on how the files were read: of their lines, their order and their places.

With h the first 48 bits of a line's SHA-256 and p the byte where the line
begins, behind the header, a file has the sums of h and of h * p, modulo a prime.
A line elsewhere, or two in another order, change the second sum.  Both are plain
sums, so partial results add up in any grouping; and the digest of files put
together follows from theirs, as bytes before a file add their number times its
first sum to the second one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import running

PRIME = (1 << 61) - 1


def _mod(value: Column) -> Column:
    return F.pmod(value, F.lit(PRIME).cast("decimal(19,0)")).cast("bigint")


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.sha2(line.cast("binary"), 256), 1, 12), 16, 10).cast("bigint")


def file_digests(lines: DataFrame) -> DataFrame:
    """Per ``file`` its records, bytes and sums, of ``line``, ``place`` and ``size``."""
    hashed = lines.select("file", "size", line_hash(F.col("line")).alias("h"), F.col("place"))
    term = _mod(F.col("h").cast("decimal(16,0)") * F.col("place").cast("decimal(19,0)"))
    total = lambda c: _mod(F.sum(c.cast("decimal(28,0)")))
    return hashed.groupBy("file").agg(F.count("*").alias("n_records"), F.sum("size").cast("bigint").alias("n_bytes"), total(F.col("h")).alias("sum_hash"), total(term).alias("placed_hash"))


def put_together(digests: DataFrame, order: str) -> DataFrame:
    """The digest of the files one after the other, in the order of a column, as one row."""
    placed = running(digests, [], [order], "n_bytes", "file_rank", "file_end")
    before = (F.col("file_end") - F.col("n_bytes")).cast("decimal(19,0)")
    moved = _mod(F.col("placed_hash").cast("decimal(38,0)") + _mod(F.pmod(before, F.lit(PRIME).cast("decimal(19,0)")) * F.col("sum_hash").cast("decimal(19,0)")).cast("decimal(38,0)"))
    total = lambda c: _mod(F.sum(c.cast("decimal(28,0)")))
    return placed.select("n_records", "n_bytes", "sum_hash", moved.alias("moved")).agg(
        F.sum("n_records").cast("bigint").alias("n_records"), F.sum("n_bytes").cast("bigint").alias("n_bytes"), total(F.col("sum_hash")).alias("sum_hash"), total(F.col("moved")).alias("placed_hash")
    )
