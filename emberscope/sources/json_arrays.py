"""Elements of JSON arrays saved as whole files, read by many tasks.

A file is cut into stretches of ``STRETCH`` bytes.  Where a stretch begins inside an array can
not be seen from its bytes alone, but whether it begins inside a text has two answers only: a
first pass finds for both how many brackets the stretch opens and whether it ends inside a
text, one row per stretch.  These rows, put together in the order of the file, give the state
in which each stretch begins.  A second pass then cuts the stretches at the commas of the
outermost array; an element belongs to the stretch that holds the mark before it.  Files of
one stretch need no first pass.  Elements are texts, not parsed.  A file whose name ends in
``.gz`` cannot be cut: one task unpacks it as a stream and holds one block of it.

Defined results: an empty or blank file has no element; a file that does not begin with a
bracket gives its first stretch as one text, and an array that is cut off gives the cut
element as it is, so both fail to parse, as the last element of a damaged gzip file does; null elements are left out; arrays one after the other
in a file are all read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.sources import tailing
from emberscope.sources.tailing import file_system
from emberscope.workspace import ship_package

STRETCH = 32 << 20
_BLOCK = 1 << 20
_GIVEN = 1 << 20  # characters of elements in one batch
MOST_TASKS = 20_000
PACKED = ".gz"
_NO_END = 1 << 62

_QUOTE, _ESCAPE = 0x22, 0x5C
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1  # brackets and braces
_COMMA = 0x2C


class _Scan:
    """State after some bytes: inside a text or not, whether the next byte is escaped, depth of brackets."""

    def __init__(self, inside: bool, depth: int, escaped: bool = False):
        self.inside, self.depth, self.escaped = inside, depth, escaped

    def marks(self, data: np.ndarray) -> np.ndarray:
        """Positions in a block of the marks of the outermost array: its brackets and the commas between elements.

        Only quotes, brackets and commas are looked at one by one, and of the commas those outside elements.
        """
        quotes = self._quotes(data)
        brackets = np.flatnonzero(_STEP[data])
        brackets = brackets[(np.searchsorted(quotes, brackets) + self.inside) % 2 == 0]
        steps = _STEP[data[brackets]].astype(np.int64)
        after = self.depth + np.cumsum(steps)
        ends = ((steps == 1) & (after == 1)) | ((steps == -1) & (after == 0))
        commas = np.flatnonzero(data == _COMMA)
        depth = np.concatenate([[self.depth], after])
        open_at = np.flatnonzero(depth == 1)  # stretches between brackets that lie in no element
        begins, stops = np.concatenate([[0], brackets])[open_at], np.concatenate([brackets, [len(data)]])[open_at]
        turns = np.bincount(np.searchsorted(commas, begins), minlength=len(commas) + 1)
        turns = turns - np.bincount(np.searchsorted(commas, stops), minlength=len(commas) + 1)
        commas = commas[np.cumsum(turns)[:-1] > 0]
        commas = commas[(np.searchsorted(quotes, commas) + self.inside) % 2 == 0]
        self.inside = bool((len(quotes) + self.inside) % 2)
        self.depth = int(depth[-1])
        return np.sort(np.concatenate([brackets[ends], commas]))

    def _quotes(self, data: np.ndarray) -> np.ndarray:
        """Positions of the quotes that no odd run of backslashes stands before."""
        quotes, slashes = np.flatnonzero(data == _QUOTE), np.flatnonzero(data == _ESCAPE)
        if not len(data) or not (len(slashes) or self.escaped):
            return quotes
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)  # of each run
        begins, ends = slashes[first], slashes[np.append(first[1:], len(slashes)) - 1] if len(slashes) else slashes
        odd = (ends - begins + 1 + ((begins == 0) & self.escaped)) % 2 == 1
        escaped = ends[odd] + 1
        if self.escaped and data[0] != _ESCAPE:
            escaped = np.append(0, escaped)
        self.escaped = bool(len(escaped) and escaped[-1] == len(data))
        return quotes[~np.isin(quotes, escaped)]


def _escaped_at(stream, at: int) -> bool:
    """Whether an odd number of backslashes stands before that byte."""
    run = 0
    while at > 0:
        begin = max(0, at - 1024)
        data = stream.read_at(at - begin, begin)
        own = len(data) - len(data.rstrip(b"\\"))
        run += own
        if own < len(data):
            break
        at = begin
    return run % 2 == 1


class _Unpacked:
    """A gzip file read forward block by block; what follows damage is a text that no parser takes."""

    def __init__(self, stream):
        self.parts, self.at, self.held = tailing._unpacked(stream, "gzip"), 0, b""

    def read_at(self, n: int, at: int) -> bytes:
        self.held, self.at = self.held[at - self.at :], at
        while len(self.held) < n:
            try:
                data = next(self.parts, None)
            except (zlib.error, OSError, EOFError):
                data, self.parts = tailing.DAMAGED.encode(), iter(())
            if data is None:
                break
            self.held += data
        return self.held[:n]


def _opened(uri: str):
    system, path, _ = file_system(unquote(uri))
    return system.open_input_file(path)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, length, end) to what the stretch does, for both ways in which it may begin."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            with _opened(r["file"]) as stream:
                escaped = _escaped_at(stream, r["start"])
                ways = [_Scan(inside, 0, escaped) for inside in (False, True)]
                for at in range(r["start"], r["end"], _BLOCK):
                    data = np.frombuffer(stream.read_at(min(_BLOCK, r["end"] - at), at), np.uint8)
                    for way in ways:
                        way.marks(data)
            rows.append((r["file"], r["start"], *[x for way in ways for x in (way.inside, way.depth)]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in _SUMMARY_TYPES], _SUMMARY_NAMES)


_SUMMARY = "file string, start long, out_inside boolean, out_depth long, in_inside boolean, in_depth long"
_SUMMARY_NAMES = [c.split()[0] for c in _SUMMARY.split(", ")]
_SUMMARY_TYPES = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]


def _states(rows: pd.DataFrame) -> pd.DataFrame:
    """The stretches of one file, in order, to the state in which each begins."""
    rows = rows.sort_values("start")
    inside, depth, found = False, 0, []
    for r in rows.itertuples():
        found.append((r.file, r.start, inside, depth))
        inside, depth = (r.in_inside, depth + r.in_depth) if inside else (r.out_inside, depth + r.out_depth)
    return pd.DataFrame(found, columns=["file", "start", "inside", "depth"])


def _elements_of(stream, start: int, end: int, length: int, inside: bool, depth: int) -> Iterator[bytes]:
    """Texts of the elements whose mark lies in the stretch."""
    if start == 0:
        head = stream.read_at(min(length, _BLOCK), 0)
        if head.strip() and not head.lstrip().startswith(b"["):
            yield stream.read_at(min(length, end) if end < _NO_END else STRETCH, 0)
            return
    scan = _Scan(inside, depth, _escaped_at(stream, start))
    held: list[bytes] | None = None  # the parts of the element being read
    at = start
    while at < (end if held is None else length):
        data = stream.read_at(min(_BLOCK, length - at if at >= end else end - at), at)
        if not data:
            break
        begin = 0
        for mark in scan.marks(np.frombuffer(data, np.uint8)).tolist():
            if held is not None:
                held.append(data[begin:mark])
                yield b"".join(held)
            if at + mark >= end:  # what this mark begins belongs to the next stretch
                return
            held, begin = None if data[mark] in b"]}" else [], mark + 1
        if held is not None:
            held.append(data[begin:])
        at += len(data)
    if held is not None:
        yield b"".join(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches with their state to (file, value)."""
    for batch in batches:
        for r in batch.to_pylist():
            texts, size = [], 0
            with _opened(r["file"]) as stream:
                parts = (r["start"], r["end"], r["length"], r["inside"], r["depth"])
                if r["file"].endswith(PACKED):
                    stream, parts = _Unpacked(stream), (0, _NO_END, _NO_END, False, 0)
                for element in _elements_of(stream, *parts):
                    text = element.strip()
                    if text and text != b"null":
                        texts.append(text.decode("utf-8", "replace"))
                        size += len(text)
                    if size >= _GIVEN:
                        yield _given(r["file"], texts)
                        texts, size = [], 0
            if texts:
                yield _given(r["file"], texts)


def _given(file: str, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(texts), pa.string()), pa.array(texts, pa.string())], ["file", "value"])


def array_elements(spark: SparkSession, pattern: str, stretch: int = STRETCH) -> DataFrame:
    """``file, value`` for each element of the arrays in the files that match."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(pattern).select(F.col("_metadata.file_path").alias("file"), "length").where("length > 0")
    own = F.when(F.col("file").endswith(PACKED), F.col("length")).otherwise(F.lit(stretch)).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.col("stretch"))
    stretches = files.withColumn("stretch", own).select("file", "length", "stretch", F.explode(starts).alias("start"))
    stretches = stretches.withColumn("end", F.least(F.col("start") + F.col("stretch"), F.col("length")))
    tasks = min(max(stretches.count(), 1), MOST_TASKS)
    large = _dealt(stretches.where(F.col("length") > F.col("stretch")), tasks)
    states = large.select("file", "start", "end").mapInArrow(_summaries, _SUMMARY)
    states = states.groupBy("file").applyInPandas(_states, "file string, start long, inside boolean, depth long")
    known = stretches.join(states, ["file", "start"], "left").select(
        "file", "start", "end", "length", F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth")
    )
    return _dealt(known, tasks).mapInArrow(partial(_cut), "file string, value string")


def _dealt(stretches: DataFrame, tasks: int) -> DataFrame:
    """A stretch a task: by range of names and positions, as hashes of a few of them often meet."""
    return stretches.repartitionByRange(tasks, "file", "start")
