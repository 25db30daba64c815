"""Which bucket a record belongs to, and which records stay.

A name is known (in the header), ``*`` or unknown.  Unknown names go the way of
``*`` and are never taken for another reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.header import refs_frame
from tidemark.functions.keys import sort_key
from tidemark.operators.dictionary import known
from tidemark.schema import DISCORDANT, MAPQ_MOST, UNMAPPED

#: Bucket names up to so many are a literal of the plan; more are joined.
LITERAL_NAMES = 512


def _resolve(df: DataFrame, refs: DataFrame, name: Column, to: str) -> DataFrame:
    side = refs.select(F.col("ref_idx").alias(to), F.col("ref_name").alias(f"{to}_name"))
    return df.join(side, name == F.col(f"{to}_name"), "left").drop(f"{to}_name")


def quality(df: DataFrame, min_mapq: int, unmapped: Column | None = None) -> DataFrame:
    """The records of quality ``min_mapq`` or more, and all ``unmapped`` ones."""
    if not 0 <= min_mapq <= MAPQ_MOST:
        raise ValueError(f"min_mapq is 0 to {MAPQ_MOST}")
    good = F.col("mapq") >= min_mapq
    return df.filter(good if unmapped is None else unmapped | good)


def route(
    df: DataFrame,
    names: list[str] | DataFrame,
    layout: str = "single",
    uniq: str | None = None,
    min_mapq: int = 0,
    discordant: str = "inline",
    order: str = "coordinate",
    broadcast_names: int | None = None,
) -> DataFrame:
    """``df`` with ``bucket``, ``bucket_idx`` and ``key``, without the records that the quality filter drops.

    ``names`` are the references in header order, or a DataFrame of them
    (``ref_idx``, ``ref_name``).  Buckets come in that order, then discordant,
    then unmapped, whose records aren't filtered and have key 0.  With ``uniq``
    every record goes to the one bucket of that name.
    """
    if layout not in ("single", "paired") or discordant not in ("inline", "separate"):
        raise ValueError(f"no such layout or discordant mode: {layout}, {discordant}")
    if uniq is not None:
        if layout != "paired":
            raise ValueError("uniq needs the paired layout")
        return quality(df, min_mapq).select("*", F.lit(uniq).alias("bucket"), F.lit(0).alias("bucket_idx"), sort_key(order).alias("key"))
    refs, n = known(df, names, broadcast_names)
    unmapped_idx, discordant_idx = n + 1, n
    found = _resolve(df, refs, F.col("rname"), "own_idx")
    own = F.col("own_idx")
    if layout == "single":
        bucket_idx = F.coalesce(own, F.lit(unmapped_idx))
    else:
        mate_name = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
        found = _resolve(found, refs, mate_name, "mate_idx")
        mate = F.col("mate_idx")
        apart = F.lit(discordant_idx) if discordant == "separate" else own
        bucket_idx = (
            F.when(own.isNotNull() & (own == mate), own)
            .when(own.isNotNull() & mate.isNotNull(), apart)
            .when((F.col("rname") == "*") & mate.isNotNull(), mate)
            .when(own.isNotNull() & (F.col("rnext") == "*"), own)
            .otherwise(F.lit(unmapped_idx))
        )
        # an own name with = resolves to itself, so a known one is concordant and * stays unmapped
    found = found.withColumn("bucket_idx", bucket_idx.cast("int")).drop("own_idx", "mate_idx")
    unmapped = F.col("bucket_idx") == unmapped_idx
    kept = quality(found, min_mapq, unmapped)
    key = F.when(unmapped, F.lit(0).cast("bigint")).otherwise(sort_key(order))
    if not isinstance(names, DataFrame) and n <= LITERAL_NAMES:
        return kept.select("*", F.get(F.array(*map(F.lit, [*names, DISCORDANT, UNMAPPED])), F.col("bucket_idx")).alias("bucket"), key.alias("key"))
    # the record's own bucket has the name it was looked up by; only the bucket number is the same for all names
    all_names = refs.select("ref_idx", "ref_name").unionAll(refs_frame(df.sparkSession, [DISCORDANT, UNMAPPED]).select((F.col("ref_idx") + n).cast("int").alias("ref_idx"), "ref_name"))
    labels, _ = known(df, all_names.select(F.col("ref_idx").alias("bucket_idx"), F.col("ref_name").alias("bucket")), broadcast_names)
    return kept.join(labels, "bucket_idx").withColumn("key", key)
