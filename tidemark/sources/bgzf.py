"""Block gzip: gzip members of at most 64 KiB that carry their own size."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.places import files, place

#: Raw bytes of a block; so many fit into 64 KiB even if they can't be compressed.
RAW_BLOCK = 64_512
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_HEAD = "<4BI2BH2BHH"
_MAGIC = b"\x1f\x8b\x08\x04"
#: Compressed bytes that a task reads.
RANGE = 1 << 22
#: More raw bytes than a compressed byte can stand for.
MOST_RAW = 1100
#: Bits of a virtual offset that tell the place inside a block; those above are the place of the block.
INNER = 16


def block(raw: bytes, level: int = 3) -> bytes:
    """One block of at most ``RAW_BLOCK`` bytes."""
    if len(raw) > RAW_BLOCK:
        raise ValueError(f"a block holds {RAW_BLOCK} bytes at most")
    deflate = zlib.compressobj(level if 0 <= level <= 9 else -1, zlib.DEFLATED, -15, 8)
    body = deflate.compress(raw) + deflate.flush()
    head = struct.pack(_HEAD, 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<2I", zlib.crc32(raw), len(raw))


def compress(raw: bytes, level: int = 3) -> bytes:
    """Blocks without the end marker."""
    return b"".join(block(raw[i : i + RAW_BLOCK], level) for i in range(0, len(raw), RAW_BLOCK))


def blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and raw bytes of each block; raises where the framing is broken."""
    at = 0
    while at < len(data):
        if len(data) - at < 28:
            raise ValueError(f"block at {at} is cut off")
        *magic, _, _, _, extra, b, c, two, last = struct.unpack_from(_HEAD, data, at)
        if magic != [31, 139, 8, 4] or (extra, b, c, two) != (6, 66, 67, 2):
            raise ValueError(f"no block header at {at}")
        end = at + last + 1
        if end > len(data):
            raise ValueError(f"block at {at} is cut off")
        raw = zlib.decompress(data[at + 18 : end - 8], -15)
        if struct.unpack_from("<2I", data, end - 8) != (zlib.crc32(raw), len(raw)):
            raise ValueError(f"block at {at} has another checksum or length")
        yield at, raw
        at = end


def _begins_block(head: bytes, at: int = 0) -> bool:
    return head[at : at + 4] == _MAGIC and head[at + 10 : at + 16] == b"\6\0BC\2\0"


def is_blocked(uri: str) -> bool:
    """Whether a file begins with a block."""
    system, path = place(uri)
    with system.open_input_file(path) as file:
        head = file.read(18)
    return len(head) == 18 and _begins_block(head)


def first_block(file: BinaryIO, begin: int, size: int) -> int:
    """The first block at or after ``begin``: a header behind which headers follow to the end, or for three blocks."""
    file.seek(begin)
    data = file.read(1 << 18)
    at = data.find(_MAGIC)
    while at >= 0:
        here = at
        for _ in range(3):
            if here == len(data) or begin + here == size:
                return begin + at
            if not _begins_block(data, here):
                break
            here += struct.unpack_from("<H", data, here + 16)[0] + 1
        else:
            return begin + at
        at = data.find(_MAGIC, at + 1)
    return size


def raw_blocks(file: BinaryIO, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Offset and raw bytes of each block from ``at`` on, read one by one."""
    file.seek(at)
    while at < size:
        head = file.read(18)
        if len(head) < 18 or not _begins_block(head):
            raise ValueError(f"no block header at {at}")
        last = struct.unpack_from("<H", head, 16)[0]
        for _, raw in blocks(head + file.read(last - 17)):
            yield at, raw
        at += last + 1


def lines_of(uri: str, begin: int, end: int) -> Iterator[list[bytes]]:
    """The lines, in lists, that begin behind the first line end of the range (the first range: at once), the last to its end."""
    system, path = place(uri)
    with system.open_input_file(path) as file:
        size = file.size()
        first = first_block(file, begin, size) if begin else 0
        if first >= end:
            return
        held, inside = b"", begin == 0
        for at, raw in raw_blocks(file, first, size):
            if at >= end:  # only the line that runs over the end is left
                if inside:
                    stop = raw.find(b"\n")
                    held += raw if stop < 0 else raw[:stop]
                    if stop >= 0:
                        yield [held]
                        return
                    continue
                return
            if not inside:
                start = raw.find(b"\n")
                if start < 0:
                    continue
                raw, inside = raw[start + 1 :], True
            *whole, held = (held + raw).split(b"\n")
            if whole:
                yield whole
        if inside and held:
            yield [held]


def _ranges(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Ranges of files, a partition each up to some number of them."""
    ranges = [(path, at, min(at + RANGE, size)) for given in paths for path, size in files(given) for at in range(0, size, RANGE)]
    return spark.createDataFrame(ranges, "file string, begin bigint, end bigint").repartition(min(len(ranges), 4096) or 1)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file``, ``line`` and ``split`` of block-gzip files, read in parallel by ranges of their blocks.

    A split is the place where its range begins if all bytes before it stood for as many raw bytes as they can.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                for lines in lines_of(path, begin, end):
                    n = len(lines)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(lines, pa.binary()), pa.array([begin * MOST_RAW] * n, pa.int64())], ["file", "line", "split"])

    return _ranges(spark, paths).mapInArrow(read, "file string, line binary, split bigint").selectExpr("file", "cast(line as string) line", "split")


def block_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file``, ``place`` and raw bytes ``n_raw`` of each block, and ``raw_place``, the raw bytes of the file before it.

    Only the headers and the last bytes of blocks are looked at; nothing is decompressed.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = place(uri)
                with system.open_input_file(path) as file:
                    size = file.size()
                    at, places, raws = first_block(file, begin, size) if begin else 0, [], []
                    while at < min(end, size):
                        file.seek(at)
                        head = file.read(18)
                        if len(head) < 18 or not _begins_block(head):
                            raise ValueError(f"no block header at {at} of {uri}")
                        after = at + struct.unpack_from("<H", head, 16)[0] + 1
                        file.seek(after - 4)
                        places.append(at)
                        raws.append(struct.unpack("<I", file.read(4))[0])
                        at = after
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(raws, pa.int64())], ["file", "place", "n_raw"])

    from tidemark.operators.order import running  # the order of blocks needs no task that holds a file's

    found = _ranges(spark, paths).mapInArrow(walk, "file string, place bigint, n_raw bigint")
    return running(found, ["file"], ["place"], "n_raw", "block", "raw_end").select("file", "place", "n_raw", (F.col("raw_end") - F.col("n_raw")).alias("raw_place"))


def virtual(places: DataFrame, table: DataFrame) -> DataFrame:
    """``places`` (``file``, ``raw``) with the virtual offset ``voffset`` of each raw place.

    Blocks hold 64 KiB at most, so a place meets its block by the number of 64 KiB
    stretches before it: each block is listed for those it lies in, two at most.
    """
    shift = lambda c: F.shiftrightunsigned(c, INNER)
    held = table.filter("n_raw > 0").withColumn("stretch", F.explode(F.sequence(shift(F.col("raw_place")), shift(F.col("raw_place") + F.col("n_raw") - 1))))
    held = held.select(F.col("file").alias("of"), "stretch", "place", "raw_place", "n_raw")
    inside = F.col("raw") - F.col("raw_place")
    met = places.join(held, (F.col("file") == F.col("of")) & (shift(F.col("raw")) == F.col("stretch")) & (inside >= 0) & (inside < F.col("n_raw")))
    return met.select(*places.columns, (F.shiftleft("place", INNER) + inside).alias("voffset"))


def fetch(wanted: DataFrame) -> DataFrame:
    """``wanted`` (``file``, ``voffset``) with the ``line`` that begins there; places of a block are served by reading it once.

    Repeated places give repeated lines.  A place outside its block fails.
    """
    spread = wanted.select("file", F.shiftrightunsigned("voffset", INNER).alias("place"), "voffset").repartition("file", "place").sortWithinPartitions("file", "place", "voffset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, source, at, raw = None, None, None, b""
        for batch in batches:
            names, voffsets, lines = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for uri, voffset in zip(names, voffsets):
                if uri != now:
                    if source:
                        source.close()
                    system, path = place(uri)
                    now, source, at = uri, system.open_input_file(path), None
                here, inner = voffset >> INNER, voffset & ((1 << INNER) - 1)
                if here != at:
                    more = raw_blocks(source, here, source.size())
                    at, raw = here, next(more)[1]
                if inner >= len(raw):
                    raise ValueError(f"nothing at {voffset} of {uri}")
                while (stop := raw.find(b"\n", inner)) < 0:  # the line runs on in the next block
                    following = next(more, None)
                    if following is None:
                        stop = len(raw)
                        break
                    raw += following[1]
                lines.append(raw[inner:stop])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lines, pa.binary())], ["file", "voffset", "line"])
        if source:
            source.close()

    return spread.mapInArrow(read, "file string, voffset bigint, line binary").selectExpr("file", "voffset", "cast(line as string) line")
