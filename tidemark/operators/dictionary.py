"""Reference dictionaries of any size: from header lines that are a DataFrame, with names looked up by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.header import refs_frame
from tidemark.operators.order import running

#: Dictionaries up to so many names are broadcast; larger ones meet the records in a shuffle join, whose hot names adaptive execution splits.
BROADCAST_NAMES = 1_000_000


def dictionary(lines: DataFrame, order: str = "src_offset") -> DataFrame:
    """``ref_idx``, ``ref_name`` of the @SQ lines among header lines (``line`` and a column that has their order)."""
    named = lines.filter(F.col("line").startswith("@SQ")).select(F.regexp_extract("line", r"\tSN:(\S+)", 1).alias("ref_name"), order, F.lit(1).alias("one"))
    ranked = running(named.filter("ref_name != ''"), [], [order], "one", "ref_idx", "ref_end")
    return ranked.select((F.col("ref_idx") - 1).cast("int").alias("ref_idx"), "ref_name")


def repeated_names(refs: DataFrame) -> DataFrame:
    """Names that a dictionary has more than once: how often, and where first."""
    return refs.groupBy("ref_name").agg(F.count("*").alias("times"), F.min("ref_idx").alias("first_idx")).filter("times > 1")


def checked(refs: DataFrame) -> DataFrame:
    """The dictionary, whose names are all different; raises if they aren't."""
    if found := repeated_names(refs).orderBy("first_idx").limit(5).collect():
        raise ValueError(f"the header repeats reference names: {', '.join(r.ref_name for r in found)}")
    return refs


def known(df: DataFrame, names: list[str] | DataFrame, broadcast_names: int | None = None) -> tuple[DataFrame, int]:
    """The dictionary as a DataFrame, with a hint if it is small enough to broadcast, and its size."""
    refs = names if isinstance(names, DataFrame) else refs_frame(df.sparkSession, names)
    n = refs.count() if isinstance(names, DataFrame) else len(names)
    most = BROADCAST_NAMES if broadcast_names is None else broadcast_names
    return F.broadcast(refs) if n <= most else refs.hint("merge"), n


def known_refs(df: DataFrame, names: list[str] | DataFrame, broadcast_names: int | None = None) -> DataFrame:
    """The records whose reference is in the dictionary."""
    return df.join(known(df, names, broadcast_names)[0], F.col("rname") == F.col("ref_name"), "left_semi")


def unknown_refs(df: DataFrame, names: list[str] | DataFrame, broadcast_names: int | None = None) -> DataFrame:
    """The records whose reference is neither ``*`` nor in the dictionary."""
    named = df.filter(F.col("rname") != "*")
    return named.join(known(df, names, broadcast_names)[0], F.col("rname") == F.col("ref_name"), "left_anti")
