"""Compression of vectors to short codes: one codebook per part, searched through LAESA pivots.

Vectors become integers and are cut into ``parts`` equal parts.  The first entries of each
part's starting codebook are its pivots, and stay so: every part's distance to them is
computed once and written with it.  In each round only the distances between pivots and
codebook entries are new.  By the triangle inequality the difference of a part's and an
entry's distance to a pivot bounds the distance between the two from below; the entries are
tried in the order of their largest such bound, with exact integer distances, until the next
bound exceeds the best distance found.  Bounds are lowered by more than their rounding error,
so the answer is that of a full search, ties included.

Each round is one pass: a task adds up its parts by entry, Spark adds up the tasks, and only
the codebooks reach the driver (``entries`` times the vector's width).

Defined results: a null vector or one with a null or non-finite component is left out;
vectors shorter than the longest, and widths that are no multiple of ``parts``, are filled up
with zeros; repeated rows count each; equal ids are ordered by their components, null ids
last; with fewer than ``entries`` vectors the codebooks are smaller; an empty table gives an
empty result; components of 2^27 or more after scaling (less beyond 64 components) end with an
error; rows without a label form one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.tables import settled
from emberscope.llm.vectors import TOTALS, added, added_at, matrix_of, partial_totals, total, vectors

FACTOR = 4096
PARTS, ENTRIES, ROUNDS, PIVOTS = 8, 16, 6, 8
_SLICE = 4096  # vectors at a time
_ROUNDING = 1e-6  # relative; more than single precision loses


def _parts(column: pa.Array, parts: int, size: int) -> np.ndarray:
    return matrix_of(column, parts * size).reshape(-1, parts, size).astype(np.int64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def pivot_distances(values: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(n, parts, pivots) distances of (n, parts, size) parts to their (parts, pivots, size) pivots."""
    return np.stack([np.sqrt(_squared(values, pivots[:, j])) for j in range(pivots.shape[1])], axis=-1)


def nearest(values: np.ndarray, away: np.ndarray, entries: np.ndarray, entries_away: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of one part position: each part's nearest entry (ties: the lower index), the squared
    distance, and how many distances were evaluated.

    ``away`` and ``entries_away`` are the distances of parts and entries to the pivots.
    """
    n = len(values)
    bound = np.zeros((n, len(entries)))
    for j in range(away.shape[1]):
        a, b = away[:, j, None].astype(np.float64), entries_away[None, :, j]
        np.maximum(bound, np.abs(a - b) - _ROUNDING * (a + b), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1) ** 2 * (1 - _ROUNDING)
    best, found = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    left, evaluated = np.arange(n), 0
    for rank in range(len(entries)):
        left = left[bound[left, rank] <= best[left]]
        if not len(left):
            break
        entry = order[left, rank]
        distance = _squared(values[left], entries[entry])
        evaluated += len(left)
        better = (distance < best[left]) | ((distance == best[left]) & (entry < found[left]))
        best[left[better]], found[left[better]] = distance[better], entry[better]
    return found, best, evaluated


def _measured(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, ints) with the distances of its parts to the pivots."""
    parts, n_pivots, size = pivots.shape
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            rows = batch.slice(at, _SLICE)
            away = pivot_distances(_parts(rows.column(2), parts, size), pivots).astype(np.float32)
            offsets = np.arange(rows.num_rows + 1, dtype=np.int32) * (parts * n_pivots)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(away.ravel()))
            yield pa.RecordBatch.from_arrays([*rows.columns, lists], ["vec_id", "label", "ints", "away"])


def _coded(batch: pa.RecordBatch, books: np.ndarray, pivots: np.ndarray) -> Iterator[tuple]:
    """Slices of a batch: first row, parts, codes (n, parts), error of each vector, evaluations of each slice."""
    parts, n_pivots, size = pivots.shape
    books_away = np.stack([pivot_distances(books[:, e][None], pivots)[0] for e in range(books.shape[1])], axis=1)
    for at in range(0, batch.num_rows, _SLICE):
        rows = batch.slice(at, _SLICE)
        values = _parts(rows.column("ints"), parts, size)
        away = matrix_of(rows.column("away"), parts * n_pivots).reshape(-1, parts, n_pivots)
        codes, error, evaluated = np.zeros(values.shape[:2], np.int64), np.zeros(len(values), np.int64), 0
        for q in range(parts):
            codes[:, q], distance, tried = nearest(values[:, q], away[:, q], books[q], books_away[q])
            error += distance
            evaluated += tried
        yield at, values, codes, error, evaluated


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's sums by part, entry and component, its number of parts by entry, and its evaluations."""
    parts, entries, size = books.shape
    sums, counts, tried = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64), 0
    for batch in batches:
        for _, values, codes, _, evaluated in _coded(batch, books, pivots):
            rows = (codes + np.arange(parts) * entries).ravel()
            added_at(sums, rows, values.reshape(-1, size))
            counts += np.bincount(rows, minlength=parts * entries)
            tried += evaluated
    yield partial_totals(np.concatenate([sums.ravel(), counts, [tried]]))


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, _, codes, error, _ in _coded(batch, books, pivots):
            texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            columns = [batch.column(0).slice(at, _SLICE), batch.column(1).slice(at, _SLICE), pa.array(texts), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])


class Codebooks:
    """Trained codebooks (parts, entries, size), and the share of all distances each round evaluated."""

    def __init__(self, entries: np.ndarray, shares: list[float]):
        self.entries, self.shares = entries, shares

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def trained(measured: DataFrame, books: np.ndarray, pivots: np.ndarray, rounds: int) -> Codebooks:
    """The codebooks after ``rounds`` of assigning all parts and moving each entry to their floored mean."""
    parts, entries, size = books.shape
    books, shares = books.copy(), []
    cells = parts * entries
    for _ in range(rounds):
        own = partial(_sums, books=books.copy(), pivots=pivots)
        found = added(measured.select("ints", "away").mapInArrow(own, TOTALS), cells * (size + 1) + 1)
        for cell, count in enumerate(found[cells * size : -1]):
            if count:
                books[cell // entries, cell % entries] = [s // count for s in found[cell * size : (cell + 1) * size]]
        shares.append(found[-1] / max(1, entries * sum(found[cells * size : -1])))
    return Codebooks(books, shares)


def prepared(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, pivots: int = PIVOTS, factor: int = FACTOR):
    """(vec_id, label, ints, away) of the usable vectors, written; the starting codebooks; the pivots."""
    ints = vectors(embeddings, ["vec_id", "label"], factor)
    first = ints.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()  # as many rows
    size = -(-max(ints.agg(F.max(F.size("ints"))).first()[0] or 1, 1) // parts)
    books = np.zeros((len(first), parts * size), np.int64)
    for i, row in enumerate(first):
        books[i, : len(row["ints"])] = row["ints"]
    books = books.reshape(-1, parts, size).transpose(1, 0, 2).copy()
    fixed = books[:, :pivots].copy()
    measured = ints.mapInArrow(partial(_measured, pivots=fixed), f"{_head(ints)}, ints array<int>, away array<float>")
    return settled(measured if first else measured.limit(0), "pivot-distances"), books, fixed


def _head(df: DataFrame) -> str:
    types = dict(df.dtypes)
    return f"vec_id {types['vec_id']}, label {types['label']}"


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS, factor: int = FACTOR) -> DataFrame:
    """Per vector: vec_id, code, error, label_error, codebooks_sha256; at most 256 ``entries``."""
    measured, books, fixed = prepared(embeddings, parts, entries, pivots, factor)
    if not books.shape[1]:
        measured, rounds = measured.limit(0), 0
    final = trained(measured, books, fixed, rounds)
    coded = measured.select("vec_id", "label", "ints", "away").mapInArrow(
        partial(_assigned, books=final.entries, pivots=fixed), f"{_head(measured)}, code string, error long"
    )
    coded = settled(coded, "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(total("error").cast("long").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(final.sha256()).alias("codebooks_sha256")
    )
