"""Sorting a SAM file, from the file to its sorted files."""

from __future__ import annotations

import argparse
import os

from pyarrow import fs
from pyspark.sql import SparkSession

from tidemark.functions.header import Header
from tidemark.operators.route import route
from tidemark.schema import FIELDS, UNMAPPED
from tidemark.sources.datasource import header_of, register
from tidemark.sources.places import place
from tidemark.sources.sam import read_sam
from tidemark.sources.sink import write_sorted


def sort_sam(
    spark: SparkSession,
    path: str,
    out_dir: str,
    min_mapq: int = 0,
    layout: str = "single",
    uniq: str | None = None,
    order: str = "coordinate",
    fmt: str = "bgzf",
    merge: bool = False,
    level: int = 3,
    discordant: str = "inline",
    mode: str = "error",
    parse_mode: str = "FAILFAST",
    partitions: int | None = None,
    late: bool = False,
    regions: dict[str, tuple[int, int]] | None = None,
) -> dict[str, int]:
    """Sort a SAM file by bucket and key; returns the records of each file written to ``out_dir``.

    Records with equal keys stay in the order of the file.  Buckets without
    records have no file.  With ``late``, for plain files, lines aren't shuffled:
    the tasks that write read them from the file, by their places.  ``regions``
    takes the place of each bucket in its file: its first byte and the one behind
    its last, as virtual offsets if the file is block-gzip.
    """
    system, folder = place(out_dir)
    if system.get_file_info(folder).type != fs.FileType.Directory:
        raise NotADirectoryError(out_dir)
    if late:
        if path.endswith((".gz", ".bam")):
            raise ValueError("only lines of plain files can be read by their places")
        register(spark)
        header = Header(tuple(header_of(path)[0]))
        fields = [n for n, _ in FIELDS if n in ("qname", "rname", "pos", "mapq", "rnext")]
        kinds = dict(FIELDS) | {"src_offset": "bigint", "size": "int", "_corrupt": "string"}
        columns = [*fields, "src_offset", "size", *(["_corrupt"] if parse_mode == "PERMISSIVE" else [])]
        records = spark.read.format("sam").option("mode", parse_mode).schema(", ".join(f"{n} {kinds[n]}" for n in columns)).load(path)
    else:
        records, header = read_sam(spark, path, parse_mode, exact=False)
    if parse_mode == "PERMISSIVE":
        records = records.filter("_corrupt is null")
    routed = route(records, header.references() if uniq is None else [uniq], layout, uniq, min_mapq, discordant, order)
    base = os.path.splitext(os.path.basename(path))[0]
    return write_sorted(routed, out_dir, header.rewritten(order), fmt, base if merge else None, level, mode, partitions, path if late else None, regions=regions)


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark", description="Sort a SAM file by reference and coordinate, or by read name.")
    parser.add_argument("sam_file")
    parser.add_argument("out_dir")
    parser.add_argument("-q", dest="min_mapq", type=int, default=0, metavar="N", help="least mapping quality (0)")
    parser.add_argument("-p", dest="layout", action="store_const", const="paired", default="single", help="paired-end reads")
    parser.add_argument("-u", dest="uniq", metavar="NAME", help="all records are of this one reference (implies -p)")
    parser.add_argument("-n", dest="order", action="store_const", const="queryname", default="coordinate", help="sort by read name")
    for flag, name in (("-g", "bgzf"), ("-b", "bam"), ("-s", "sam")):
        parser.add_argument(flag, dest="fmt", action="store_const", const=name, default="bgzf", help=f"write {name}")
    parser.add_argument("-m", dest="merge", action="store_true", help="one file for all buckets")
    parser.add_argument("-c", dest="level", type=int, default=3, metavar="N", help="compression level (3)")
    parser.add_argument("--discordant", choices=("inline", "separate"), default="inline", help=f"pairs on two references: with their own, or apart (never {UNMAPPED})")
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("--late", action="store_true", help="shuffle the places of records and not their lines (plain files)")
    return parser


def main(argv: list[str] | None = None) -> None:
    options = vars(arguments().parse_args(argv))
    options["mode"] = "overwrite" if options.pop("overwrite") else "error"
    if options["uniq"]:
        options["layout"] = "paired"
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    for name, n in sort_sam(spark, options.pop("sam_file"), options.pop("out_dir"), **options).items():
        print(f"{name}\t{n}")
