"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its sixteen 4-bit segments,
a point of a small integer grid.  Two fingerprints that differ by d bits lie at
a Manhattan distance of at most d there, so the distance is a lower bound that
can be range-joined on the grid: points at a distance of two or less have a
grid cell in common that is within one step of both.  Cells with a single
fingerprint are dropped; in the others the bound is verified exactly.

Neither step lists pairs.  Fingerprints within two bits of each other share a
*centre*, a 64-bit value within one bit of both, and the reverse holds too.  So
in each crowded cell a fingerprint names its centres that lie in this cell, at
most four, and all fingerprints of a centre link to the least of them.  A group
of n near copies costs rows in proportion to n, however tight it is.

Defined results: a null, empty or blank text has fingerprint zero, which links
like any other; rows with equal ids or texts stay separate rows; a null id
never becomes a component id unless all ids of the component are null; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import bound_batches, cut, cut_small, text_or_empty
from tidemark.llm.components import components
from tidemark.operators.order import partitions_of

SHINGLE = 3
SEED = 42
_BLOCK = 1 << 14
_BLANK = re.compile(rb"[ \t-\r]")
#: Bytes of a text that are split into words at a time, about.
_STRETCH = 1 << 20
#: So many crowded cells at most are broadcast, 8 bytes each; more meet the fingerprints in a shuffle.
BROADCAST_CELLS = 500_000


def _word_runs(octets: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs, so that a very long text is never all split at once."""
    begin = 0
    while len(octets) - begin > _STRETCH:
        blank = _BLANK.search(octets, begin + _STRETCH)
        if blank is None:
            break
        yield octets[begin : blank.start()].split()
        begin = blank.end()
    yield octets[begin:].split()


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of one text as an unsigned integer."""
    ones, total, held = np.zeros(64, np.int64), 0, []
    for words in _word_runs((text or "").encode().lower()):  # bytes: A-Z only, and the six ASCII blanks
        words = held + words
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
        hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
        for at in range(0, len(hashes), _BLOCK):
            octets = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        held = words[1 - SHINGLE :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(held), seed=SEED) if held else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    found = np.fromiter((fingerprint_of(t) for t in texts), np.uint64, len(texts))
    return pd.Series(found.view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of ``text``."""
    return docs.withColumn(to, _fingerprints(F.col(text)))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _counts_of_half(x: Column) -> Column:
    """Bit counts of the eight 4-bit segments of a value under 2**32, one in each hex digit."""
    pairs = x.bitwiseAND(0x55555555) + F.shiftright(x, 1).bitwiseAND(0x55555555)
    return pairs.bitwiseAND(0x33333333) + F.shiftright(pairs, 2).bitwiseAND(0x33333333)


def embedding(fingerprint: Column) -> Column:
    """The sixteen segment bit counts (0 to 4), one in each hex digit of a long."""
    high = _counts_of_half(F.shiftrightunsigned(fingerprint, 32))
    low = _counts_of_half(fingerprint.bitwiseAND(0xFFFFFFFF))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _cells(point: Column) -> Column:
    """The grid cells within one step of a point: itself, and one more or less in one segment."""
    cells = [point]
    for j in range(16):
        digit = F.shiftright(point, 4 * j).bitwiseAND(15)
        cells += [F.when(digit < 4, point + 16**j), F.when(digit > 0, point - 16**j)]
    return F.array_compact(F.array(*cells))


def _centres(fp: Column, point: Column, cell: Column) -> Column:
    """The values within one bit of ``fp`` whose embedding is ``cell``, a cell within one step of its own."""
    step = F.abs(cell - point)
    flips = []
    for k in range(4):
        bit = F.shiftleft(step, k)
        clear = fp.bitwiseAND(bit) == 0
        flips.append(F.when(clear == (cell > point), fp.bitwiseXOR(bit)))
    return F.when(cell == point, F.array(fp)).otherwise(F.array_compact(F.array(*flips)))


def links(fps: DataFrame) -> DataFrame:
    """Star edges ``u``, ``v`` that connect exactly the fingerprints (distinct, column ``fp``) within two bits."""
    points = fps.select("fp", embedding(F.col("fp")).alias("point"))
    placed = points.select("fp", "point", F.explode(_cells(F.col("point"))).alias("cell"))
    crowded = cut_small(placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell"))
    candidates = placed.join(F.broadcast(crowded) if crowded.count() <= BROADCAST_CELLS else crowded, "cell", "left_semi")
    verified = cut_small(candidates.select("fp", F.explode(_centres(F.col("fp"), F.col("point"), F.col("cell"))).alias("centre")))
    hubs = verified.groupBy("centre").agg(F.min("fp").alias("hub"), F.max("fp").alias("last")).filter("hub != last")
    return verified.join(hubs, "centre").filter("fp != hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (16 hex digits) and component id.

    The component id is the least id reachable over links of two bits or fewer.
    """
    bound_batches(docs.sparkSession, 500, "4m")
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text)).alias("fp")))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    nodes = cut_small(nodes.repartition(partitions_of(nodes), "fp"))  # not fewer, as each of these small rows grows to thirty
    roots = components(links(nodes))
    joined = roots.join(nodes, roots.node == nodes.fp).select("node", "root", "least_id")
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = joined.select("node", "root").join(least, "root").select(F.col("node").alias("fp"), "component_id")
    # a fingerprint without links is a component of its own
    classes = cut_small(nodes.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")))
    # the copies of one text meet their class in a join that can be split
    return rows.join(classes, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, whatever ids the rows repeat or lack.

    It is the row with the least id (rows without an id come last), then the
    least hash of the text and of the whole row.  Rows that are equal in all of
    these are copies of each other, of which one stays.
    """
    bound_batches(docs.sparkSession, 500, "4m")
    hashed = [f"`{name}`" for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keys = {"id": F.col(doc_id), "text": F.sha2(text_or_empty(text), 256), "row": F.xxhash64(*hashed)}
    key = F.struct(F.col(doc_id).isNull().alias("without"), *(value.alias(name) for name, value in keys.items()))
    rows = cut(docs.select(key.alias("key"), _fingerprints(F.col(text)).alias("fp")))
    nodes = rows.groupBy("fp").agg(F.min("key").alias("first"))
    nodes = cut_small(nodes.repartition(partitions_of(nodes), "fp"))
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    kept = nodes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select("first")
    keyed = docs.select(F.struct("*").alias("doc"), key.alias("key"))  # packed, so that no name of the table can clash
    same = [F.col(f"key.{name}").eqNullSafe(F.col(f"first.{name}")) for name in keys]
    return keyed.join(kept, same, "left_semi").dropDuplicates(["key"]).select("doc.*")
