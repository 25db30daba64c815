"""Queries that write files and read them again."""

from __future__ import annotations

import contextlib
import io
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.header import Header
from tidemark.lineage import checkpoint_folder, local_path, settle, write_down
from tidemark.operators.digest import file_digests, put_together
from tidemark.operators.order import running, total_order
from tidemark.operators.route import route
from tidemark.operators.stats import sortedness
from tidemark.plans.fixtures import LINE_ORDER, NAMES, lineitem_records
from tidemark.plans.sort import main, sort_sam
from tidemark.schema import DISCORDANT, UNMAPPED
from tidemark.sources import bgzf
from tidemark.sources.datasource import SPLIT, pushing, register
from tidemark.sources.sam import parse, read_lines
from tidemark.sources.sink import write_sorted

Query = Callable[[SparkSession, str], DataFrame]
#: Ranges in which the queries read what they have written, so that there are several; ``_split`` has larger ones for larger files.
SMALL_SPLIT, SPLITS = 1 << 18, 64
FLAT = ("file", "place", "size", "qname", "rname", "pos", "mapq", "rnext")


def _header() -> Header:
    return Header(("@HD\tVN:1.0\tSO:unsorted", *(f"@SQ\tSN:{name}\tLN:250000000" for name in NAMES)))


@contextlib.contextmanager
def _shared_folder(spark: SparkSession) -> Iterator[str]:
    """A folder beside the checkpoints, as a local path of the shared file system, for as long as the files are needed."""
    folder = f"{local_path(checkpoint_folder(spark))}/sam-{uuid.uuid4().hex}"
    os.makedirs(folder)
    try:
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _split(path: str) -> int:
    """Bytes of a file that a task reads: about ``SPLITS`` ranges, smaller or larger only where theirs would leave the bounds."""
    return max(SMALL_SPLIT, min(SPLIT, os.path.getsize(path) // SPLITS))


def _line() -> Column:
    return F.concat_ws("\t", "qname", F.lit("0"), "rname", "pos", "mapq", F.lit("10M"), "rnext", F.lit("0"), F.lit("0"), F.lit("ACGTACGTAC"), F.lit("FFFFFFFFFF"))


def write_source(spark: SparkSession, folder: str, to: str, copies: int = 1) -> str:
    """The records of ``lineitem_records``, each so many times, as a SAM file in source order, which the columns of the line have."""
    first, *others = LINE_ORDER
    reads = lineitem_records(spark, folder).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))) if copies > 1 else F.lit(1))
    records = reads.select(F.lit(0).alias("bucket_idx"), F.lit("source").alias("bucket"), F.col(first).alias("key"), *others, "copy", _line().alias("line"))
    header = "".join(f"{line}\n" for line in _header().lines)
    write_sorted(records, to, header, "sam", tie=(*others, "copy"))
    return f"{to}/source.sam"


def _by_command(spark: SparkSession, path: str, out_dir: str) -> list[str]:
    """The files that the command line writes."""
    with contextlib.redirect_stdout(io.StringIO()) as told:
        main(["-p", "-q", "20", "-s", path, out_dir])
    return [line.split("\t")[0] for line in told.getvalue().splitlines()]


def _sorted_files(spark: SparkSession, folder: str, work: str, sort: Callable | None = None, **options) -> list[str]:
    """Paths of the files to which the records were sorted; the source is gone."""
    source = write_source(spark, folder, work)
    paths = _sorted_to(spark, source, work, sort, **options)
    os.remove(source)
    return paths


def _sorted_to(spark: SparkSession, source: str, work: str, sort: Callable | None = None, **options) -> list[str]:
    out = f"{work}/out-{uuid.uuid4().hex[:6]}"
    os.makedirs(out)
    names = sort(spark, source, out) if sort else sort_sam(spark, source, out, layout="paired", min_mapq=20, **options)
    return [f"{out}/{name}" for name in names]


def _named(column: str = "file") -> Column:
    """The name of a file without its suffix, by searches for single characters: a pattern would try each place of a long path."""
    name = F.substring_index(column, "/", -1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1)


def _folder(column: str = "file") -> Column:
    """The name of the folder that a file is in."""
    return F.substring_index(F.substring_index(column, "/", -2), "/", 1)


def _read_back(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of files with ``file`` and their ``place`` behind the header, which all files share."""
    lines, header, head = read_lines(spark, paths)
    if header.lines[0] != "@HD\tVN:1.0\tSO:coordinate":
        raise AssertionError("the files have another header")
    return lines.withColumn("file", _named()).withColumn("place", F.col("src_offset") - head)


def _round_trip(sort: Callable | None = None, **options) -> Query:
    """Records written as SAM, sorted to files, and read back with the place they have there."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        with _shared_folder(spark) as work:
            lines = _read_back(spark, _sorted_files(spark, folder, work, sort, **options))
            records = parse(lines.drop("src_offset").withColumnRenamed("place", "src_offset"))
            return write_down(records.select("file", F.col("src_offset").alias("place"), F.col("size").cast("bigint").alias("size"), *FLAT[3:]))

    return query


def parts_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted records written with ``df.write.format("sam")``, a file for each range of a bucket, and read with ``spark.read.format("sam")``."""
    with _shared_folder(spark) as work:
        register(spark)
        routed = route(lineitem_records(spark, folder).withColumn("line", _line()), NAMES, "paired", min_mapq=20)
        ordered = total_order(routed.select("bucket_idx", "bucket", "key", *LINE_ORDER, "line"), *LINE_ORDER).select("bucket_idx", "bucket", "run_part", "line")
        ordered.write.format("sam").mode("append").options(fmt="bgzf", header=_header().rewritten("coordinate")).save(f"{work}/parts")
        found = spark.read.format("sam").schema("file string, qname string, rname string, pos bigint, mapq int, rnext string").load(f"{work}/parts")
        return write_down(found.select(_folder().alias("bucket"), "qname", "rname", "pos", "mapq", "rnext"))


def source_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Records of two references of some quality: both conditions are pushed into the scan, which cuts six columns out of a line."""
    with _shared_folder(spark) as work:
        source = write_source(spark, folder, work)
        register(spark)
        kept = spark.read.format("sam").options(split=_split(source), push=True).schema("src_offset bigint, size int, qname string, rname string, pos bigint, mapq int").load(source)
        head = sum(len(line) + 1 for line in _header().lines)
        found = kept.filter("mapq >= 30 and rname in ('chr1', 'chr2')")
        with pushing(spark):
            return write_down(found.select((F.col("src_offset") - head).alias("place"), F.col("size").cast("bigint").alias("size"), "qname", "rname", "pos", "mapq"))


def virtual_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a merged block-gzip file, found in the block table by their places and read alone by their virtual offsets."""
    with _shared_folder(spark) as work:
        paths = _sorted_files(spark, folder, work, fmt="bgzf", merge=True)
        lines, _, _ = read_lines(spark, paths)
        wanted = parse(lines).filter("pos % 5 = 0").select(F.lit(paths[0]).alias("file"), F.col("src_offset").alias("raw"))
        fetched = bgzf.fetch(bgzf.virtual(wanted, bgzf.block_table(spark, paths)))
        records = parse(fetched.select("file", "line", F.col("voffset").alias("src_offset"), (F.length("line") + 1).alias("size"), F.lit(False).alias("in_header")))
        return write_down(records.select("qname", "rname", "pos", "mapq", "rnext"))


def bucket_region(spark: SparkSession, folder: str) -> DataFrame:
    """The records of one bucket of a merged block-gzip file, of which only the bucket's blocks are read."""
    with _shared_folder(spark) as work:
        source, regions = write_source(spark, folder, work), {}
        sort_sam(spark, source, work, layout="paired", min_mapq=20, fmt="bgzf", merge=True, regions=regions)
        register(spark)
        (begin, end), path = regions["chr3"], f"{work}/source_sorted.gz"
        part = spark.read.format("sam").options(begin=begin, end=end, split=_split(path)).schema("qname string, rname string, pos bigint, mapq int, rnext string")
        return write_down(part.load(path))


def written_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each sorted file's records, bytes, digest, and neighbours in the wrong order."""
    with _shared_folder(spark) as work:
        lines = _read_back(spark, _sorted_files(spark, folder, work, fmt="bgzf"))
        key = F.when(F.col("file") == UNMAPPED, 0).otherwise(F.get(F.split("line", "\t", 5), F.lit(3)).cast("bigint"))
        body = write_down(lines.filter("not in_header").select("file", "line", "place", "size", key.alias("key")))
        order = {name: i for i, name in enumerate([*NAMES, DISCORDANT, UNMAPPED])}
        idx = F.coalesce(*(F.when(F.col("file") == name, F.lit(i)) for name, i in order.items()))
        ranked = running(body.select("file", "place", "size", "key", idx.alias("bucket_idx")), ["file"], ["place"], "size").withColumn("bucket", F.col("file"))
        wrong = sortedness(write_down(ranked)).select(F.col("bucket").alias("file"), "violations")
        return settle(file_digests(body).join(wrong, "file"))


def merged_digest(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of the merged file, and the one put together from those of the buckets' files: they are the same."""
    with _shared_folder(spark) as work:
        source = write_source(spark, folder, work)
        merged = _read_back(spark, _sorted_to(spark, source, work, fmt="bgzf", merge=True)).filter("not in_header")
        whole = file_digests(merged).withColumn("what", F.lit("merged file")).drop("file")
        apart = file_digests(_read_back(spark, _sorted_to(spark, source, work, fmt="sam")).filter("not in_header"))
        order = F.coalesce(*(F.when(F.col("file") == name, F.lit(i)) for i, name in enumerate([*NAMES, DISCORDANT, UNMAPPED])))
        together = put_together(settle(apart.withColumn("place", order)), "place").withColumn("what", F.lit("files of buckets"))
        return settle(whole.unionByName(together))


FILES: dict[str, Query] = {
    "sam_roundtrip": _round_trip(fmt="sam"),
    "bgzf_roundtrip": _round_trip(fmt="bgzf"),
    "bam_roundtrip": _round_trip(fmt="bam", level=9),
    "command_roundtrip": _round_trip(_by_command),
    "merged_roundtrip": _round_trip(fmt="bgzf", merge=True),
    "late_roundtrip": _round_trip(fmt="bgzf", late=True),
    "parts_roundtrip": parts_roundtrip,
    "source_scan": source_scan,
    "virtual_fetch": virtual_fetch,
    "bucket_region": bucket_region,
    "written_files": written_files,
    "merged_digest": merged_digest,
}
