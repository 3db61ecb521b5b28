"""Clusters of integer vectors by bit planes: exact distances from AND and popcount.

A vector's 64 components are written in two's complement and cut into bit planes: plane b is
one 64-bit word holding bit b of every component, the last plane holds the signs.  With X_a
and C_b the planes of a vector and of a centroid, their dot product is the sum of
2^(a+b) * popcount(X_a & C_b), the sign planes counted negatively; the squared distance
follows from it and both squared lengths.  All of it is exact.

The planes are written once (eight bytes a plane and vector) and every round is one pass over
them: each task adds up its vectors by centroid, and one row per task, centroid and component
is added up by Spark.  Only the centroids reach the driver: ``k`` times 64 numbers.

Defined results: a null vector, one of another length, and one with a null or non-finite
component is left out; repeated rows count each; rows with equal hashes (repeated ids) are
ordered by their components as starting centroids; a null id comes last and its row is
clustered like others; with fewer than ``k`` vectors there are fewer centroids; an empty table
gives an empty result; a table with components of 2^27 or more after scaling ends with an error.
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
from emberscope.llm.vectors import TOTALS, added, added_at, lists_of, matrix_of, partial_totals, total, vectors

WIDTH = 64
FACTOR = 1024
CLUSTERS, ROUNDS, SEED = 8, 10, 3
_SLICE = 4096  # vectors at a time


def planes_of(values: np.ndarray) -> np.ndarray:
    """(planes, n) words of (n, 64) integers; as many planes as the largest needs with its sign."""
    top = int(max(values.max(initial=0), -1 - values.min(initial=0)))
    bits = [np.packbits((values >> b & 1).astype(np.uint8), axis=1).view(np.uint64).ravel() for b in range(top.bit_length() + 1)]
    return np.stack(bits)


def values_of(planes: np.ndarray) -> np.ndarray:
    """The (n, 64) integers of (planes, n) words."""
    out = np.zeros((planes.shape[1], WIDTH), np.int64)
    for b in range(len(planes) - 1, -1, -1):
        bits = np.unpackbits(np.ascontiguousarray(planes[b]).view(np.uint8).reshape(-1, 8), axis=1)
        out = -bits.astype(np.int64) if b == len(planes) - 1 else 2 * out + bits
    return out


def dots(planes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(k, n) dot products of the planes of n vectors with those of k centroids."""
    total = np.zeros((centroids.shape[1], planes.shape[1]), np.int64)
    for a in range(len(planes) - 1, -1, -1):
        row = np.zeros_like(total)
        for b in range(len(centroids) - 1, -1, -1):
            both = np.bitwise_count(planes[a] & centroids[b][:, None])
            row = row * 2 + both if b < len(centroids) - 1 else -both.astype(np.int64)
        total = total * 2 + row if a < len(planes) - 1 else -row
    return total


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, ints) to (vec_id, planes, square), rows of one batch with equally many planes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = matrix_of(batch.column(1), WIDTH).astype(np.int64)
        planes = planes_of(values)
        offsets = np.arange(len(values) + 1, dtype=np.int32) * len(planes)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(planes.T.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array((values * values).sum(axis=1))], ["vec_id", "planes", "square"])


def _planes(column: pa.Array) -> np.ndarray:
    """(planes, n) words of a column of lists; shorter lists repeat their sign plane."""
    words, bounds = lists_of(column)
    sizes = np.diff(bounds)
    at = bounds[:-1] + np.minimum(np.arange(sizes.max(initial=1))[:, None], sizes - 1)
    return words.astype(np.int64).view(np.uint64)[at]


def _nearest(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch: first row, planes, nearest centroid (ties: the smaller number), squared distance."""
    own = planes_of(centroids)
    squares = (centroids * centroids).sum(axis=1)
    for at in range(0, batch.num_rows, _SLICE):
        part = batch.slice(at, _SLICE)
        planes = _planes(part.column("planes"))
        distance = part.column("square").to_numpy() + squares[:, None] - 2 * dots(planes, own)
        nearest = distance.argmin(axis=0)
        yield at, planes, nearest, distance[nearest, np.arange(part.num_rows)]


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's sums by centroid and component, then its number of vectors by centroid."""
    k = len(centroids)
    sums, counts = np.zeros((k, WIDTH), np.int64), np.zeros(k, np.int64)
    for batch in batches:
        for _, planes, nearest, _ in _nearest(batch, centroids):
            added_at(sums, nearest, values_of(planes))
            counts += np.bincount(nearest, minlength=k)
    yield partial_totals(np.concatenate([sums.ravel(), counts]))


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, _, nearest, distance in _nearest(batch, centroids):
            columns = [batch.column(0).slice(at, _SLICE), pa.array(nearest.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])


def clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, factor: int = FACTOR) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (array<long>)."""
    spark = embeddings.sparkSession
    ints = vectors(embeddings.where(F.size("embedding") == WIDTH), ["vec_id"], factor)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = ints.orderBy(order.asc_nulls_last(), "ints").limit(k).collect()  # k rows
    centroids = np.array([r["ints"] for r in first], np.int64).reshape(-1, WIDTH)
    id_type = dict(ints.dtypes)["vec_id"]
    packed = settled(ints.mapInArrow(_packed, f"vec_id {id_type}, planes array<long>, square long"), "planes")
    n = len(centroids)
    for _ in range(rounds if n else 0):
        found = added(packed.select("planes", "square").mapInArrow(partial(_sums, centroids=centroids), TOTALS), n * (WIDTH + 1))
        for c, count in enumerate(found[n * WIDTH :]):
            if count:
                centroids[c] = [s // count for s in found[c * WIDTH : (c + 1) * WIDTH]]
    schema = f"vec_id {id_type}, cluster int, distance long"
    final = packed.select("vec_id", "planes", "square").mapInArrow(partial(_assigned, centroids=centroids), schema)
    final = settled(final if n else final.limit(0), "clusters")
    inertia = final.groupBy("cluster").agg(total("distance").cast("long").alias("cluster_inertia")).collect()  # k rows
    whole = sum(r["cluster_inertia"] for r in inertia)
    rows = []
    for r in inertia:
        own = [int(x) for x in centroids[r["cluster"]]]
        rows.append((r["cluster"], r["cluster_inertia"], whole, hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), own))
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return final.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )
