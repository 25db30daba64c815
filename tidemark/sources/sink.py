"""Sorted records to one file per bucket, or one file for all.

Two jobs write through ``df.write.format(...)``, each with Spark's two-phase
commit.  The first writes the sorted partitions as shards, under names of the
attempt, so that a task that runs twice does no harm; what the driver gets of it
is the list of shards with their sizes.  Prefix sums give each shard its place,
and the second job puts the shards together: on mounted file systems they are
copied into the files in parallel, each to its place; elsewhere, where files only
grow at their end (S3, GCS, Azure and HDFS), a task streams the shards of a file
one after the other, which object stores take in parts.  The commit of the second
job gives files their names, and the folder of the job goes, with whatever tasks
that died have left there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.operators.order import total_order
from tidemark.sources import bgzf
from tidemark.sources.datasource import FORMATS, register
from tidemark.sources.places import place

_COPY = 1 << 22
_PIECES = "target string, pieces array<struct<path:string,raw:binary,offset:bigint>>"


class AssemblyWriter(DataSourceArrowWriter):
    """Rows have a target and pieces, files or bytes, in order; targets are in the folder of the job until its commit."""

    def __init__(self, options: dict[str, str]):
        self.work, self.folder, self.positioned = options["work"], options["path"], options["positioned"] == "true"
        self.names = json.loads(options["names"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, work = place(self.work)
        for batch in iterator:
            for target, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # a task that runs again writes the same bytes to the same places, or the whole file anew
                with open(f"{work}/{target}", "r+b") if self.positioned else system.open_output_stream(f"{work}/{target}", compression=None) as out:
                    for piece in pieces:
                        if self.positioned:
                            out.seek(piece["offset"])
                        if piece["path"] is None:
                            out.write(piece["raw"])
                            continue
                        with system.open_input_stream(piece["path"], compression=None) as source:
                            while data := source.read(_COPY):
                                out.write(data)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, work = place(self.work)
        _, folder = place(self.folder)
        for name in self.names:
            system.move(f"{work}/{name}", f"{folder}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, work = place(self.work)
        if system.get_file_info(work).type == fs.FileType.Directory:
            system.delete_dir(work)


class AssemblySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sam_assembly"

    def writer(self, schema: StructType, overwrite: bool) -> AssemblyWriter:
        return AssemblyWriter(dict(self.options))


def _name(bucket: str, merge: str | None, fmt: str) -> str:
    return f"{f'{merge}_sorted' if merge else bucket}.{FORMATS[fmt]}"


def _files(shards: list[list], merge: str | None, fmt: str, top: bytes) -> dict[str, tuple[list[tuple[str | None, bytes | None, int]], int]]:
    """For each file its pieces, with their places, and its records: the header, the shards in order, an end marker after each bucket."""
    ends, found, ats = bgzf.EOF if fmt != "sam" else b"", {}, {}
    for i, (idx, bucket, _, path, size, records) in enumerate(shards):
        name = _name(bucket, merge, fmt)
        pieces, n = found.get(name, ([(None, top, 0)], 0))
        at = ats.get(name, len(top))
        pieces.append((path, None, at))
        at += size
        if ends and (i + 1 == len(shards) or shards[i + 1][0] != idx):
            pieces.append((None, ends, at))
            at += len(ends)
        found[name], ats[name] = (pieces, n + records), at
    return found


def write_sorted(
    df: DataFrame, folder: str, header: str, fmt: str = "bgzf", merge: str | None = None, level: int = 3, mode: str = "error", partitions: int | None = None, source: str | None = None, positioned: bool | None = None,
    regions: dict[str, tuple[int, int]] | None = None, tie: tuple[str, ...] = ("src_offset",),
) -> dict[str, int]:
    """Write routed records (``bucket_idx``, ``bucket``, ``key``, ``src_offset``, ``line``) in order; the records of each file.

    Equal keys are in the order of ``src_offset``, or of the columns ``tie``.

    A bucket's file is ``<bucket>.<suffix>``; with ``merge`` all go to
    ``<merge>_sorted.<suffix>``, in the order of the buckets.  Each file begins
    with the header.  Existing files are an error, or are replaced with
    ``mode="overwrite"``.  With ``source``, a plain file, records have ``size``
    instead of ``line``: only what places them is shuffled, and the tasks that
    write read the lines from the file.  ``regions`` takes each bucket's place.
    """
    if fmt not in FORMATS or mode not in ("error", "overwrite"):
        raise ValueError(f"no such format or mode: {fmt}, {mode}")
    spark: SparkSession = df.sparkSession
    register(spark)
    spark.dataSource.register(AssemblySource)
    job, folder = uuid.uuid4().hex, folder.rstrip("/")
    system, root = place(folder)
    if positioned is None:
        positioned = isinstance(system, fs.LocalFileSystem)
    work = f"{root}/.work-{job}"
    try:
        columns = ["bucket_idx", "bucket", "run_part", *(["src_offset", F.col("size").cast("int").alias("size")] if source else ["line"])]
        kept = df.select("bucket_idx", "bucket", "key", *tie, "size" if source else "line")
        rows = total_order(kept, *tie, partitions=partitions).select(*columns)
        options = {"fmt": fmt, "level": level, "bare": job} | ({"source": source} if source else {})
        rows.write.format("sam").options(**options).mode("append").save(folder)
        with system.open_input_stream(f"{work}/shards.json") as file:
            shards = json.loads(file.read())  # a row for each range and bucket in it
        top = bgzf.compress(header.encode(), level) if fmt != "sam" else header.encode()
        found = _files(shards, merge, fmt, top)
        taken = [name for name in found if system.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound]
        if taken and mode == "error":
            raise FileExistsError(f"in {folder}: {', '.join(taken)}")
        if positioned:
            for name, (pieces, _) in found.items():
                with open(f"{work}/{name}", "wb"):
                    pass
            moves = [(name, [piece]) for name, (pieces, _) in found.items() for piece in pieces]
        else:
            moves = [(name, pieces) for name, (pieces, _) in found.items()]
        if regions is not None:
            ats = {path: at for pieces, _ in found.values() for path, _, at in pieces}
            bits = bgzf.INNER if fmt != "sam" else 0
            for _, bucket, _, path, size, _ in shards:
                regions[bucket] = (regions.get(bucket, (ats[path] << bits,))[0], (ats[path] + size) << bits)
        if moves:
            frame = spark.createDataFrame(moves, _PIECES).repartition(min(len(moves), 4 * spark.sparkContext.defaultParallelism))
            frame.write.format("sam_assembly").options(work=f"{folder}/.work-{job}", positioned=str(positioned).lower(), names=json.dumps([*found])).mode("append").save(folder)
        return {name: records for name, (_, records) in found.items()}
    finally:
        if system.get_file_info(work).type == fs.FileType.Directory:
            system.delete_dir(work)
