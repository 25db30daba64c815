"""SAM text as a DataFrame with byte offsets.

Spark's text source reads the file in splits, with the line feed as the only
line end, so a carriage return stays part of its line; block-gzip files are read
in ranges of blocks.  Offsets run on inside a split as its
lines stream by.  A sort needs no more: a split begins before all its lines and
behind those of the splits before it, so places of one scan are in the order of
the file; rows of a plain file are just numbered.  For exact offsets one more
pass sums the bytes of each split.

The header is the lines beginning with ``@`` before the first other line, and is
read by the driver alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.functions.header import Header
from tidemark.schema import FIELDS, MAPQ_MOST
from tidemark.sources import bgzf
from tidemark.sources.places import readable


#: Bytes of headers that surely end in the first split.
SMALL_HEADER = 1 << 15


def _run_on(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Bytes before each line in its split; a split's lines come one after the other."""
    split, held = None, 0
    for splits, sizes in batches:
        size, at = sizes.to_numpy(np.int64), splits.to_numpy(np.int64)
        before = np.cumsum(size) - size
        new = np.flatnonzero(np.r_[at[:1] != split, at[1:] != at[:-1]])
        base = np.zeros(len(at), np.int64)
        starts = np.r_[0, new] if not len(new) or new[0] else new
        for begin, end in zip(starts, np.r_[starts[1:], len(at)]):
            base[begin:end] = before[begin] - (held if begin == 0 and begin not in new else 0)
        yield pd.Series(before - base)
        if len(at):
            split, held = at[-1], int(before[-1] - base[-1] + size[-1])


def _blocked(path: str) -> bool:
    """Block-gzip files that Arrow can open are read in ranges of blocks; Spark's own reader takes any other gzip file in one task."""
    return path.endswith((".gz", ".bam")) and readable(path) and bgzf.is_blocked(path)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file``, ``line``, ``split``, ``size`` of all files."""
    blocked = [path for path in paths if _blocked(path)]
    plain = [path for path in paths if path not in blocked]
    frames = []
    if blocked:
        frames.append(bgzf.read_lines(spark, blocked))
    if plain:
        text = spark.read.option("lineSep", "\n").text(plain)
        frames.append(text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("split")))
    lines = reduce(DataFrame.unionAll, frames)
    return lines.select("file", "line", "split", (F.octet_length("line") + 1).cast("bigint").alias("size"))


def read_header(spark: SparkSession, path: str) -> tuple[Header, int]:
    """The header of a file and its bytes, through the file system that Spark reads the file from."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path)) if ":/" in path else jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(jvm.org.apache.hadoop.fs.Path(path.removesuffix(".bam") + ".gz" if path.endswith(".bam") else path))
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        lines = []
        while (line := reader.readLine()) is not None and line.startswith("@"):
            lines.append(line)
    finally:
        stream.close()
    return Header(tuple(lines)), sum(len(line.encode()) + 1 for line in lines)


def read_lines(spark: SparkSession, path: str | list[str], exact: bool = True) -> tuple[DataFrame, Header, int]:
    """All lines of a file with ``file``, ``src_offset``, ``size``, ``in_header``; its header; and the bytes of the header.

    A last line without a line feed counts as if it had one.  Unless ``exact``,
    offsets are in the order of the file but may be other numbers.  Of several files
    each has its own offsets and header; the first one's is returned.
    """
    paths = [path] if isinstance(path, str) else path
    lines, (header, head) = _lines(spark, paths), read_header(spark, paths[0])
    if not exact and len(paths) == 1 and head <= SMALL_HEADER and not _blocked(paths[0]):
        # the splits of one file are dealt to partitions in its order, so rows are numbered in it, too, and no Python is needed
        placed = lines.withColumn("src_offset", F.monotonically_increasing_id())
        in_header = (F.col("src_offset") < len(header.lines)) & F.col("line").startswith("@")
        return placed.select("file", "line", "src_offset", "size", in_header.alias("in_header")), header, head
    inside = F.pandas_udf(_run_on, LongType()).asNondeterministic()  # its state follows the lines, so nothing may be filtered before it
    placed = lines.withColumn("inside", inside(F.xxhash64("file", "split"), "size"))
    if exact or len(paths) > 1 or head > SMALL_HEADER:
        begins, last, total, own = [], None, 0, head
        for s in lines.groupBy("file", "split").agg(F.sum("size").alias("bytes")).orderBy("file", "split").collect():  # a row for each split
            if s.file != last:
                last, total, own = s.file, 0, read_header(spark, s.file)[1] if len(paths) > 1 else head
            begins.append((s.file, s.split, total, own))
            total += s.bytes
        begins = spark.createDataFrame(begins, "begin_file string, begin_split bigint, begin bigint, head bigint")
        placed = placed.join(F.broadcast(begins), (F.col("file") == F.col("begin_file")) & (F.col("split") == F.col("begin_split")))
        offset, own = F.col("begin") + F.col("inside"), F.col("head")
    else:
        # a split but the first leaves out at least the line feed that ends the line it begins in
        offset, own = F.col("split") + F.col("inside") + F.when(F.col("split") > 0, 1).otherwise(0), F.lit(head)
    return placed.select("file", "line", offset.alias("src_offset"), "size", (offset < own).alias("in_header")), header, head


def parse(lines: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Records of ``line``s (those of the header are left out), with all fields.

    A record without eleven fields, or whose position or quality is no number
    (or no quality of 0 to 255), fails the query, or in ``PERMISSIVE`` mode has
    its line in ``_corrupt``.  So does a line of a header behind a record.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"no such mode: {mode}")
    parts = lines.filter(~F.col("in_header")).withColumn("parts", F.split("line", "\t", len(FIELDS) + 1))
    fields = [F.get("parts", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(FIELDS)]
    found = parts.select("file", "src_offset", "size", *fields, F.get("parts", F.lit(len(FIELDS))).alias("tags"), "line", F.size("parts").alias("parts"))
    bad = (F.col("parts") < len(FIELDS)) | F.col("pos").isNull() | F.col("mapq").isNull() | ~F.col("mapq").between(0, MAPQ_MOST)
    if mode == "PERMISSIVE":
        return found.withColumn("_corrupt", F.when(bad, F.col("line"))).drop("parts")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("malformed record: "), F.substring("line", 1, 200)))).otherwise(F.col("line"))
    return found.withColumn("line", checked).drop("parts")


def read_sam(spark: SparkSession, path: str, mode: str = "FAILFAST", exact: bool = True) -> tuple[DataFrame, Header]:
    """The records of a SAM file and its header."""
    lines, header, _ = read_lines(spark, path, exact)
    return parse(lines, mode).drop("file"), header
