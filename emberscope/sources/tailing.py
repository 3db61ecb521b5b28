"""A streaming source that follows growing log files line by line.

Spark's own file source takes a file once, as it is when it is found.  Here the offset of a
stream names for every file the byte up to which it was taken, so lines that an application
appends later arrive once, over restarts too.  The driver only lists names and sizes and, for
a file still written to, looks for its last line end; the bytes are read by tasks, one task
per stretch of ``STRETCH`` bytes, and a line belongs to the stretch in which it begins.

Which files are open: names ending in ``.inprogress``, and the file with the highest number of
a rolling log whose folder has the mark of a running application.  An open file is taken up
to its last line end, a closed one to its end.  A file keeps its position when it loses the
suffix.  Compressed files cannot be followed; they are taken whole once they are closed: gzip
under any name, bz2, and zstd.  A damaged file ends in a line that says so, and so does one
whose codec has no decoder here; both count as malformed lines.

Files last changed more than ``maxAgeDays`` (7) before the newest one leave the offset, which
keeps it as long as the files of that time; such a file is read from its beginning if it is
written to again.  A file that shrinks yields nothing until it is longer than before.
"""

from __future__ import annotations

import bz2
import re
import zlib
from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from emberscope.workspace import ship_package

# Names of open files and of rolling logs, codec suffixes, texts of broken files.
OPEN_SUFFIX = ".inprogress"
OPEN_MARK = re.compile(r"/appstatus_[^/]*\.inprogress$")
STATUS_MARK = re.compile(r"/appstatus_[^/]*$")
ROLLING = re.compile(r"^(.*/eventlog_v2_[^/]*)/events_(\d+)_[^/]*$")
CODEC = re.compile(r"\.(gz|gzip|zst|zstd|bz2|lz4|snappy|deflate)$")
DAMAGED = "damaged compressed data"
UNKNOWN = "no decoder for this codec"

STRETCH = 64 << 20
_CHUNK = 1 << 20
_LOOK_BACK = 1 << 16
MAX_AGE_DAYS = 7.0


def file_system(uri: str) -> tuple[files.FileSystem, str, str]:
    """The file system of a path, the path there, and what stands before paths in its URIs."""
    uri = re.sub(r"^file:/+", "/", uri).rstrip("/")
    system, path = files.FileSystem.from_uri(uri)
    return system, path, "file://" if uri.startswith("/") else uri.removesuffix(path)


def begins_like_gzip(uri: str) -> bool:
    system, path, _ = file_system(uri)
    with system.open_input_file(path) as stream:
        return stream.read(2) == b"\x1f\x8b"


def _last_line_end(system: files.FileSystem, path: str, size: int) -> int:
    """The position after the last line feed among the first ``size`` bytes."""
    with system.open_input_file(path) as stream:
        end = size
        while end > 0:
            begin = max(0, end - _LOOK_BACK)
            found = stream.read_at(end - begin, begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return 0


def _unpacked(stream, codec: str) -> Iterator[bytes]:
    """The bytes of a compressed stream of one or more members; ends early with an error if damaged."""
    if codec == "zstd":
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True) as reader:
            try:
                while data := reader.read(_CHUNK):
                    yield data
            except zstandard.ZstdError as error:
                raise ValueError(str(error)) from error
        return
    fresh = bz2.BZ2Decompressor if codec == "bz2" else lambda: zlib.decompressobj(wbits=31)
    unpack, members, inside = fresh(), 0, False
    while data := stream.read(_CHUNK):
        while data:
            if members and not inside and codec == "gzip" and data[:1] != b"\x1f":
                return  # what follows the last member is no log
            yield unpack.decompress(data)
            inside, data = not unpack.eof, unpack.unused_data
            if unpack.eof:
                unpack, members = fresh(), members + 1
    if inside:
        raise EOFError


class _Lines:
    """Lines with their positions, as record batches."""

    def __init__(self, file: str, at: int):
        self.file, self.at, self.rest = file, at, b""
        self.values: list[str] = []
        self.places: list[int] = []

    def feed(self, data: bytes) -> None:
        *whole, self.rest = (self.rest + data).split(b"\n")
        for line in whole:
            self.add(line, 1)

    def add(self, line: bytes, end: int = 0) -> None:
        self.values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
        self.places.append(self.at)
        self.at += len(line) + end

    def taken(self) -> pa.RecordBatch:
        columns = [pa.array([self.file] * len(self.values), pa.string()), pa.array(self.places, pa.int64()), pa.array(self.values, pa.string())]
        self.values, self.places = [], []
        return pa.RecordBatch.from_arrays(columns, ["file", "block", "value"])


class Stretch(InputPartition):
    """Bytes ``start`` to ``end`` of a file known by ``key``; ``first`` if they begin what is new of it."""

    def __init__(self, key: str, start: int, end: int, first: bool, last: int):
        self.key, self.start, self.end, self.first, self.last = key, start, end, first, last


def _opened(key: str):
    """The file of that name, or still with the suffix of open files."""
    system, path, _ = file_system(key)
    try:
        return system.open_input_file(path)
    except FileNotFoundError:
        return system.open_input_file(path + OPEN_SUFFIX)


def read_stretch(part: Stretch) -> Iterator[pa.RecordBatch]:
    named = CODEC.search(part.key)
    with _opened(part.key) as stream:
        codec = {"gz": "gzip", "zst": "zstd"}.get(named[1], named[1]) if named else None
        if codec is None and stream.read_at(2, 0) == b"\x1f\x8b":
            codec = "gzip"
        if codec is not None:
            if part.start == 0:
                stream.seek(0)
                yield from _packed_lines(part.key, stream, codec)
            return
        begin = part.start
        if not part.first:  # the line over the border belongs to the stretch before
            begin = _after_line(stream, part.start - 1, part.last)
        lines, at = _Lines(part.key, begin), begin
        while at < part.end:
            data = stream.read_at(min(_CHUNK, part.end - at), at)
            if not data:
                break
            at += len(data)
            lines.feed(data)
            yield lines.taken()
        if lines.rest:
            stop = _after_line(stream, at, part.last)
            lines.feed(stream.read_at(stop - at, at))
            if lines.rest:  # a closed file without a last line end
                lines.add(lines.rest)
            yield lines.taken()


def _after_line(stream, at: int, last: int) -> int:
    """The position after the first line feed from ``at`` on, ``last`` if there is none before."""
    while at < last:
        data = stream.read_at(min(_LOOK_BACK, last - at), at)
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        if not data:
            break
        at += len(data)
    return last


def _packed_lines(key: str, stream, codec: str) -> Iterator[pa.RecordBatch]:
    lines, fault = _Lines(key, 0), None
    if codec in ("gzip", "zstd", "bz2"):
        try:
            for data in _unpacked(stream, codec):
                lines.feed(data)
                yield lines.taken()
        except (zlib.error, OSError, EOFError, ValueError):
            fault = DAMAGED
    else:
        fault = UNKNOWN
    if lines.rest:
        lines.add(lines.rest, 1)
    if fault:
        lines.add(fault.encode())
    yield lines.taken()


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.system, self.root, self.prefix = file_system(options["path"])
        self.max_age = timedelta(days=float(options.get("maxagedays", MAX_AGE_DAYS)))
        self.stretch = int(options.get("stretch", STRETCH))
        self.seen: dict[str, tuple[int, int]] = {}  # of open files: size, last line end

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The byte up to which each file may be taken now."""
        found = self.system.get_file_info(files.FileSelector(self.root, recursive=True, allow_not_found=True))
        logs = [f for f in found if f.is_file and not re.match(r"[._]", f.base_name) and not STATUS_MARK.search(f.path)]
        running = {f.path.rsplit("/", 1)[0] for f in found if OPEN_MARK.search(f.path)}
        newest: dict[str, int] = {}
        for f in logs:
            if (m := ROLLING.match(f.path)) and m[1] in running:
                newest[m[1]] = max(int(m[2]), newest.get(m[1], -1))
        latest = max((f.mtime for f in logs), default=None)
        offset = {}
        for f in logs:
            if latest - f.mtime > self.max_age:
                continue
            m = ROLLING.match(f.path)
            is_open = f.path.endswith(OPEN_SUFFIX) or (m is not None and newest.get(m[1]) == int(m[2]))
            key = self.prefix + f.path.removesuffix(OPEN_SUFFIX)
            offset[key] = self._open_end(f) if is_open else f.size
        self.seen = {path: x for path, x in self.seen.items() if self.prefix + path.removesuffix(OPEN_SUFFIX) in offset}
        return offset

    def _open_end(self, f: files.FileInfo) -> int:
        if CODEC.search(f.path.removesuffix(OPEN_SUFFIX)):
            return 0  # taken whole when it is closed
        if self.seen.get(f.path, (-1, 0))[0] != f.size:
            self.seen[f.path] = (f.size, _last_line_end(self.system, f.path, f.size))
        return self.seen[f.path][1]

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        parts = []
        for key in sorted(end):
            begin, last = start.get(key, 0), end[key]
            for at in range(begin, last, self.stretch):
                parts.append(Stretch(key, at, min(at + self.stretch, last), at == begin, last))
        return parts

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return read_stretch(partition)

    def commit(self, end: dict) -> None:
        return None


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, block bigint, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogTailReader({k.lower(): v for k, v in self.options.items()})


def tail_lines(spark: SparkSession, root: str, max_age_days: float = MAX_AGE_DAYS) -> DataFrame:
    """``file, block, value`` of every line below a root, as it is written; ``block`` is the line's position."""
    ship_package(spark)
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("maxAgeDays", max_age_days).load(root)
