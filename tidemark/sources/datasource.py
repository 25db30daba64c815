"""``spark.read.format("sam")`` and ``df.write.format("sam")``.

    register(spark)
    spark.read.format("sam").schema("qname string, pos bigint").load("s3://reads/*.sam").filter("mapq >= 30")
    routed.write.format("sam").mode("append").option("fmt", "bgzf").option("header", header).save("out")

*Reading.*  A task reads a range of bytes, or of blocks of a block-gzip file, and
cuts it into records with array operations.  Only columns of the schema that was
asked for are cut out of the lines.  Conditions are tried before any other column
is made: those of the options ``min_mapq`` and ``rname`` (names, comma-separated),
and with the option ``push``, inside ``with pushing(spark)``, comparisons of
numbers and equality or membership of names that Spark pushes into the scan.  ``src_offset`` is the byte where a record begins, in block-gzip
files its virtual offset (place of the block times 65536 and the place in it),
which also is in the order of the file.  The options ``begin`` and ``end`` are such
offsets: only the bytes or blocks between them are read.

*Writing.*  Tasks write under names of their attempt into a folder of the job;
what a task that died or ran twice has left goes with that folder.  The job's
commit gives the files their names, its abort removes the folder.  Of each bucket
there is a folder with a whole file, header and all, for each sorted partition.
``sink.write_sorted`` makes one file for each bucket of such parts.
"""

from __future__ import annotations

import contextlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tidemark.schema import FIELDS, MAPQ_MOST
from tidemark.sources import bgzf
from tidemark.sources.places import files, gather, place, spread

FORMATS = {"sam": "sam", "bgzf": "gz", "bam": "bam"}
SCHEMA = ", ".join(["file string", "src_offset bigint", "size int", *(f"{n} {k}" for n, k in FIELDS), "tags string", "line string", "_corrupt string"])
#: Bytes of a file that a task reads, and bytes that are cut into records at once.
SPLIT, PIECE = 1 << 26, 1 << 22
#: Bytes that a task gathers before it compresses and writes them.
GATHER = 16 * bgzf.RAW_BLOCK
_NUMBER = {name: i for i, (name, _) in enumerate(FIELDS)}
_WHOLE = {name for name, kind in FIELDS if kind != "string"}
_SIZES = {"int": pa.int32(), "bigint": pa.int64()}
_COMPARE = {GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


@dataclass
class Range(InputPartition):
    """Bytes of a file, and where its records begin."""

    uri: str
    begin: int
    end: int
    kind: str  # plain, blocks or stream
    head: int  # offset of the first record that is wanted
    stop: int = 1 << 63  # offset behind the last one
    inside: bool = False  # whether the range begins where a line may begin


class _Lines:
    """Lines of a buffer: where they and their fields begin and end."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends
        self.tabs = np.flatnonzero(data == 9)
        self.first = np.searchsorted(self.tabs, starts)
        self.count = np.searchsorted(self.tabs, ends) - self.first

    def keep(self, mask: np.ndarray) -> None:
        self.starts, self.ends, self.first, self.count = (x[mask] for x in (self.starts, self.ends, self.first, self.count))

    def bounds(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of a field of each line; a missing one is empty.  The one behind the last has the rest of the line."""
        tabs = np.r_[self.tabs, 0]
        at = lambda i: tabs[np.minimum(self.first + i, len(tabs) - 1)]
        begin = self.starts if not number else np.where(self.count >= number, at(number - 1) + 1, self.ends)
        end = self.ends if number == len(FIELDS) else np.where(self.count > number, at(number), self.ends)
        return begin, end

    def text(self, begin: np.ndarray, end: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
        at, offsets = spread(begin, end - begin)
        found = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(self.data[at])).cast(pa.string())
        return found if missing is None else pc.if_else(pa.array(missing), pa.scalar(None, pa.string()), found)

    def number(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of a field, and which are no whole numbers of up to 18 digits."""
        begin, end = self.bounds(number)
        lead = self.data[np.minimum(begin, len(self.data) - 1)] if len(self.data) else np.zeros(0, np.uint8)
        sign = (end > begin) & ((lead == 45) | (lead == 43))
        begin, minus = begin + sign, sign & (lead == 45)
        size = end - begin
        value, bad = np.zeros(len(begin), np.int64), (size < 1) | (size > 18)
        for i in range(int(size[~bad].max(initial=0))):
            digit = self.data[np.minimum(begin + i, len(self.data) - 1)].astype(np.int64) - 48
            inside = (i < size) & ~bad
            bad |= inside & ((digit < 0) | (digit > 9))
            value = np.where(inside, value * 10 + digit, value)
        return np.where(minus, -value, value), bad


@dataclass
class SamReader(DataSourceReader):
    path: str
    columns: list[tuple[str, str]]
    permissive: bool = False
    split: int = SPLIT
    region: tuple[int, int] | None = None
    tests: list[tuple[str, type, object]] = field(default_factory=list)

    def partitions(self) -> Sequence[InputPartition]:
        found = []
        for uri, size in files(self.path):
            system, path = place(uri)
            packed = uri.endswith((".gz", ".bam"))
            kind = "blocks" if packed and bgzf.is_blocked(uri) else "stream" if packed else "plain"
            _, head = header_of(uri)
            step = size if kind == "stream" else self.split
            if self.region and kind != "stream":
                bits = bgzf.INNER if kind == "blocks" else 0
                begin, end = self.region
                places = range(begin >> bits, min((end >> bits) + 1, size), max(step, 1)) if end > begin else ()
                found += [Range(uri, at, min(at + step, size), kind, max(head, begin), end, at == begin >> bits) for at in places]
                continue
            found += [Range(uri, at, min(at + step, size), kind, head) for at in range(0, size, max(step, 1))]
        return found or [Range("", 0, 0, "plain", 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.uri:
            for data, starts, ends, offsets in _lines_in(partition):
                inside = (offsets >= partition.head) & (offsets < partition.stop)
                yield self._records(partition.uri, _Lines(data, starts[inside], ends[inside]), offsets[inside])

    def _passes(self, lines: _Lines) -> np.ndarray:
        kept = np.ones(len(lines.starts), bool)
        for name, kind, value in self.tests:
            number, whole = _NUMBER[name], name in _WHOLE
            if whole:
                found, bad = lines.number(number)
                kept &= ~bad if kind is IsNotNull else ~bad & (_COMPARE[kind](found, value) if kind in _COMPARE else np.isin(found, [value] if kind is EqualTo else list(value)))
            elif kind is IsNotNull:
                kept &= lines.count >= number
            else:
                wanted = pa.array([value] if kind is EqualTo else list(value), pa.string())
                kept &= pc.is_in(lines.text(*lines.bounds(number)), value_set=wanted).to_numpy(zero_copy_only=False)
        return kept

    def _records(self, uri: str, lines: _Lines, offsets: np.ndarray) -> pa.RecordBatch:
        wanted = {name for name, _ in self.columns}
        bad = lines.count < len(FIELDS) - 1
        for name in ("pos", "mapq") if wanted & {"pos", "mapq", "_corrupt"} or not self.permissive else ():
            value, wrong = lines.number(_NUMBER[name])
            bad |= wrong | ((value < 0) | (value > MAPQ_MOST) if name == "mapq" else False)
        if not self.permissive and bad.any():
            i = int(np.flatnonzero(bad)[0])
            raise ValueError(f"malformed record: {lines.data[lines.starts[i] : lines.ends[i]][:200].tobytes().decode(errors='replace')}")
        kept = self._passes(lines)
        lines.keep(kept)
        offsets, bad = offsets[kept], bad[kept]
        arrays = []
        for name, kind in self.columns:
            if name == "file":
                arrays.append(pa.array([uri] * len(offsets), pa.string()))
            elif name == "src_offset":
                arrays.append(pa.array(offsets, pa.int64()))
            elif name == "size":
                arrays.append(pa.array(lines.ends - lines.starts + 1, pa.int32()))
            elif name in ("line", "_corrupt"):
                arrays.append(lines.text(lines.starts, lines.ends, ~bad if name == "_corrupt" else None))
            elif name == "tags":
                arrays.append(lines.text(*lines.bounds(len(FIELDS)), lines.count < len(FIELDS)))
            elif name in _WHOLE:
                value, wrong = lines.number(_NUMBER[name])
                arrays.append(pa.array(value, pa.int64(), mask=wrong).cast(_SIZES[kind], safe=False))
            else:
                arrays.append(lines.text(*lines.bounds(_NUMBER[name]), lines.count < _NUMBER[name]))
        return pa.RecordBatch.from_arrays(arrays, [name for name, _ in self.columns])


@dataclass
class PushingReader(SamReader):
    """A reader that takes conditions from Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for test in filters:
            name = getattr(test, "attribute", ("",))[0]
            if type(test) in _COMPARE and name in _WHOLE or isinstance(test, (EqualTo, In)) and name in _NUMBER:
                self.tests.append((name, type(test), test.value))
            elif not (isinstance(test, IsNotNull) and name in _NUMBER):
                yield test
                continue
            if isinstance(test, IsNotNull):
                self.tests.append((name, IsNotNull, None))


def _streamed(uri: str) -> Iterator[bytes]:
    """The raw bytes of a gzip file of any kind."""
    system, path = place(uri)
    with system.open_input_stream(path, compression=None) as file:
        member = zlib.decompressobj(31)
        while data := file.read(1 << 20):
            while data:
                if raw := member.decompress(data):
                    yield raw
                data = member.unused_data
                if member.eof:
                    member = zlib.decompressobj(31)


def _chunks(part: Range) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Stretches of raw bytes of the range and of what follows it; where blocks begin in each, and the offsets of those places."""
    system, path = place(part.uri)
    if part.kind == "stream":
        at = 0
        for raw in _streamed(part.uri):
            yield raw, np.zeros(1, np.int64), np.array([at])
            at += len(raw)
        return
    with system.open_input_file(path) as file:
        size = file.size()
        if part.kind == "plain":
            at = part.begin
            while at < size:
                raw = file.read_at(min(PIECE, max(part.end - at, 1 << 16)), at)
                yield raw, np.zeros(1, np.int64), np.array([at])
                at += len(raw)
            return
        at = part.begin if part.inside or not part.begin else bgzf.first_block(file, part.begin, size)
        held, begins, places, n = [], [], [], 0
        for at, raw in bgzf.raw_blocks(file, at, size) if at < part.end else ():
            if held and (n >= PIECE or at >= part.end):
                yield b"".join(held), np.array(begins), np.array(places) << bgzf.INNER
                held, begins, places, n = [], [], [], 0
            begins.append(n)
            places.append(at)
            held.append(raw)
            n += len(raw)
        if held:
            yield b"".join(held), np.array(begins), np.array(places) << bgzf.INNER


def _limit(part: Range) -> int:
    """Offset of the first place behind the range: a line that begins just there is still the range's, as the next one skips it."""
    if part.kind != "blocks":
        return part.end
    system, path = place(part.uri)
    with system.open_input_file(path) as file:
        size = file.size()
        if part.end >= size:
            return size << bgzf.INNER
        for at, raw in bgzf.raw_blocks(file, bgzf.first_block(file, part.end, size), size):
            if raw:
                return at << bgzf.INNER
        return size << bgzf.INNER


def _lines_in(part: Range) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The lines that begin in the range behind its first line end (in the first range: at once), up to its limit: bytes, starts, ends, offsets."""
    limit, endless = _limit(part), part.kind == "stream"
    held, held_at, inside = b"", None, part.begin == 0 or endless or part.inside
    for raw, begins, places in _chunks(part):
        skip = 0
        if not inside:
            skip = raw.find(b"\n") + 1
            if not skip:
                if places[-1] > limit:
                    return
                continue
            inside = True
        data, n = np.frombuffer(held + raw, np.uint8), len(held)
        stops = np.flatnonzero(data == 10)
        stops = stops[stops >= skip]
        starts = np.r_[skip, stops[:-1] + 1][: len(stops)]
        offset = lambda at: (lambda i: places[i] + at - begins[i])(np.maximum(np.searchsorted(begins, at, "right") - 1, 0))  # noqa: B023, E731
        offsets = offset(starts - n)
        if n and len(offsets):
            offsets[0] = held_at
        own = endless | (offsets <= limit)
        if own.any():
            yield data, starts[own], stops[own], offsets[own]
        if not own.all():
            return
        rest = int(stops[-1]) + 1 if len(stops) else skip
        if len(stops) or not n:
            held_at = int(offset(np.array(rest - n))) if rest < len(data) else None
        held = data[rest:].tobytes()
        if held_at is not None and held_at > limit and not endless:
            return
    if held:
        data = np.frombuffer(held, np.uint8)
        yield data, np.zeros(1, np.int64), np.array([len(data)]), np.array([held_at])


def header_of(uri: str) -> tuple[list[str], int]:
    """The lines of a file's header, and the offset of the first record (of the end, if there is none)."""
    lines = []
    for data, starts, ends, offsets in _lines_in(Range(uri, 0, 1 << 62 - bgzf.INNER, _kind(uri), 0)):
        for start, end, offset in zip(starts.tolist(), ends.tolist(), offsets.tolist()):
            if data[start : start + 1].tobytes() != b"@":
                return lines, offset
            lines.append(data[start:end].tobytes().decode())
    return lines, 1 << 62


def _kind(uri: str) -> str:
    packed = uri.endswith((".gz", ".bam"))
    return "blocks" if packed and bgzf.is_blocked(uri) else "stream" if packed else "plain"


@dataclass
class Shards(WriterCommitMessage):
    """Bucket number, bucket, partition, path, bytes and records of what a task has written."""

    rows: list[tuple[int, str, int, str, int, int]]


class SamWriter(DataSourceArrowWriter):
    """Rows have ``bucket_idx``, ``bucket``, ``run_part`` (ranges in their order) and ``line``, and come sorted.

    Instead of ``line`` there may be ``src_offset`` and ``size`` of lines in the
    plain file that the option ``source`` names: they are read from there.
    """

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.folder, self.fmt = options["path"], options.get("fmt", "bgzf")
        if self.fmt not in FORMATS:
            raise ValueError(f"no such format: {self.fmt}")
        self.level, self.header, self.source = int(options.get("level", 3)), options.get("header", ""), options.get("source")
        self.bare = options.get("bare")  # a name for the folder where bare shards stay
        self.overwrite, self.packed = overwrite, self.fmt != "sam"
        self.columns = schema.names
        missing = {"bucket_idx", *(["line"] if not self.source else ["src_offset", "size"])} - {*schema.names}
        if missing:
            raise ValueError(f"columns to write are missing: {', '.join(sorted(missing))}")
        self.work = f"{self.folder.rstrip('/')}/.work-{self.bare or uuid.uuid4().hex}"

    def _bytes(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The lines of a batch with their ends, one after the other, and where each begins."""
        if self.source:
            starts, sizes = (batch.column(self.columns.index(c)).to_numpy().astype(np.int64) for c in ("src_offset", "size"))
            return gather(self.source, starts, sizes), np.r_[0, np.cumsum(sizes)]
        lines = batch.column(self.columns.index("line")).cast(pa.large_binary())
        _, at, data = lines.buffers()
        at = np.frombuffer(at, np.int64)[lines.offset : lines.offset + len(lines) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = at[1:] - at[0]
        return np.insert(raw, ends, 10), np.r_[0, ends + np.arange(1, len(ends) + 1)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shards:
        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        system, work = place(self.work)
        system.create_dir(work)
        done, now, out, held, size = [], None, None, [], 0

        def put(raw: bytes) -> None:
            if raw:
                out["file"].write(packed := bgzf.compress(raw, self.level) if self.packed else raw)
                out["bytes"] += len(packed)

        def flush(last: bool) -> None:
            nonlocal held, size
            raw = b"".join(held)
            whole = len(raw) if last or not self.packed else len(raw) // bgzf.RAW_BLOCK * bgzf.RAW_BLOCK
            put(raw[:whole])
            held, size = ([raw[whole:]] if whole < len(raw) else []), len(raw) - whole

        def close() -> None:
            if out is not None:
                flush(True)
                if self.packed and not self.bare:
                    out["file"].write(bgzf.EOF)
                out["file"].close()
                done.append((now[0], out["bucket"], now[1], out["path"], out["bytes"], out["rows"]))

        at = {name: self.columns.index(name) for name in ("bucket_idx", "bucket", "run_part") if name in self.columns}
        for batch in iterator:
            if not batch.num_rows:
                continue
            raw, ends = self._bytes(batch)
            idx = batch.column(at["bucket_idx"]).to_numpy()
            part = batch.column(at["run_part"]).to_numpy() if "run_part" in at else np.full(len(idx), task)
            cuts = [0, *(np.flatnonzero((np.diff(idx) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(idx)]
            for begin, end in zip(cuts, cuts[1:]):
                if (here := (int(idx[begin]), int(part[begin]))) != now:
                    close()
                    now, path = here, f"{work}/{here[0]}-{here[1]}-{task}-{attempt}"
                    bucket = batch.column(at["bucket"])[begin].as_py() if "bucket" in at else str(here[0])
                    out = {"file": system.open_output_stream(path, compression=None), "path": path, "bytes": 0, "rows": 0, "bucket": bucket}
                    if not self.bare:
                        put(self.header.encode())
                held.append(raw[ends[begin] : ends[end]].tobytes())
                out["rows"] += end - begin
                size += len(held[-1])
                if size >= GATHER:
                    flush(False)
        close()
        return Shards(done)

    def commit(self, messages: list[Shards | None]) -> None:
        system, work = place(self.work)
        rows = sorted(row for message in messages if message for row in message.rows)
        if self.bare:
            system.create_dir(work)
            with system.open_output_stream(f"{work}/shards.json") as file:
                file.write(json.dumps(rows).encode())
            return
        _, folder = place(self.folder)
        for bucket in {row[1] for row in rows} if self.overwrite else ():
            if system.get_file_info(f"{folder}/{bucket}").type == fs.FileType.Directory:
                system.delete_dir(f"{folder}/{bucket}")
        job = uuid.uuid4().hex[:8]
        for _, bucket, part, path, _, _ in rows:
            system.create_dir(f"{folder}/{bucket}")
            system.move(path, f"{folder}/{bucket}/part-{part:06}-{job}.{FORMATS[self.fmt]}")
        self.abort(messages)

    def abort(self, messages: list[Shards | None]) -> None:
        system, work = place(self.work)
        if system.get_file_info(work).type == fs.FileType.Directory:
            system.delete_dir(work)


class SamSource(DataSource):
    """SAM text, plain or in block-gzip."""

    @classmethod
    def name(cls) -> str:
        return "sam"

    def schema(self) -> str:
        return SCHEMA if self.options.get("mode", "").upper() == "PERMISSIVE" else SCHEMA.rpartition(",")[0]

    def reader(self, schema: StructType) -> SamReader:
        kinds = dict(re.findall(r"(\w+) (\w+)", SCHEMA))
        columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        if wrong := [f"{name} {kind}" for name, kind in columns if kinds.get(name) != kind]:
            raise ValueError(f"no such columns: {', '.join(wrong)}; there are {SCHEMA}")
        mode = self.options.get("mode", "FAILFAST").upper()
        if mode not in ("FAILFAST", "PERMISSIVE"):
            raise ValueError(f"no such mode: {mode}")
        region = (int(self.options.get("begin", 0)), int(self.options.get("end", 1 << 62))) if {"begin", "end"} & {*self.options} else None
        tests = [("mapq", GreaterThanOrEqual, int(self.options["min_mapq"]))] if "min_mapq" in self.options else []
        tests += [("rname", In, tuple(self.options["rname"].split(",")))] if "rname" in self.options else []
        made = PushingReader if self.options.get("push", "false").lower() == "true" else SamReader
        return made(self.options["path"], columns, mode == "PERMISSIVE", int(self.options.get("split", SPLIT)), region, tests)

    def writer(self, schema: StructType, overwrite: bool) -> SamWriter:
        return SamWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(SamSource)


@contextlib.contextmanager
def pushing(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark pushes filters into sources that are written in Python and loaded with the option ``push``.

    Each query there needs its own ``load``: Spark (4.1) keeps what a query has
    pushed with the loaded DataFrame, and a later query over the same one that
    pushes nothing would be filtered, too.
    """
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
