"""Files by their URI, on any file system that Arrow knows: mounted paths, S3, GCS, Azure, and HDFS where its client library is there.

Tasks open files themselves, so a URI must mean the same for the driver and all
executors; credentials are those that Arrow finds in their environment.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

from tidemark.lineage import local_path

#: Names that Hadoop has for schemes that Arrow calls otherwise.
_ALIASES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasb": "abfs", "wasbs": "abfs"}
#: Reads nearer to each other than this become one, up to so many bytes.
GAP, MOST = 1 << 16, 1 << 23


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path there."""
    scheme = re.match("([A-Za-z][A-Za-z0-9+.-]+):", uri)
    if scheme is None or scheme[1] == "file":
        return fs.LocalFileSystem(), local_path(uri)
    return fs.FileSystem.from_uri(_ALIASES.get(scheme[1], scheme[1]) + uri[len(scheme[1]) :])


def readable(uri: str) -> bool:
    """Whether Arrow can open the file."""
    try:
        system, path = place(uri)
        return system.get_file_info(path).type == fs.FileType.File
    except (OSError, ValueError, ImportError, NotImplementedError):
        return False


def files(uri: str) -> list[tuple[str, int]]:
    """The files of a path, a folder or a pattern, as URIs with their sizes; hidden ones (``.``, ``_``) of a folder don't count."""
    system, path = place(uri)
    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    if re.search(r"[*?\[]", path):
        top = re.split(r"[^/]*[*?\[]", path)[0].rstrip("/") or "/"
        found = [i for i in system.get_file_info(fs.FileSelector(top, recursive=True)) if fnmatch.fnmatchcase(i.path, path)]
    else:
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(uri)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        found = [i for i in found if not any(part[:1] in "._" for part in i.path[len(path) :].split("/") if part)]
    return sorted((prefix + i.path, i.size) for i in found if i.type == fs.FileType.File)


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all bytes of stretches, one stretch after the other, and where each begins among them (one more: their end)."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes), offsets


def gather(uri: str, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of stretches of a file, in the order given; the file is read in its own order, near stretches at once."""
    system, path = place(uri)
    if not len(starts):
        return np.zeros(0, np.uint8)
    at, _ = spread(starts, sizes)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")[at]  # only touched pages are read
    order = np.argsort(starts, kind="stable")
    held, _ = spread(np.zeros(len(sizes), np.int64), sizes)
    found, offsets = np.empty(len(at), np.uint8), np.r_[0, np.cumsum(sizes)]
    with system.open_input_file(path) as file:
        for begin, end, rows in _near(starts[order], sizes[order]):
            data = np.frombuffer(file.read_at(end - begin, begin), np.uint8)
            for row in order[rows].tolist():
                found[offsets[row] : offsets[row + 1]] = data[starts[row] - begin : starts[row] - begin + sizes[row]]
    return found


def _near(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, slice]]:
    """Begin, end and rows of reads that serve sorted stretches."""
    first, begin, end = 0, int(starts[0]), int(starts[0] + sizes[0])
    for i in range(1, len(starts)):
        here, after = int(starts[i]), int(starts[i] + sizes[i])
        if here - end > GAP or after - begin > MOST:
            yield begin, end, slice(first, i)
            first, begin, end = i, here, after
        end = max(end, after)
    yield begin, end, slice(first, len(starts))
