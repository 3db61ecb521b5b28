"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at ``virtual`` places of a ring of hashes.  A document's place is the hash
of its id; it goes to the first shard clockwise that is not full, so what overflows a full
shard continues clockwise.  Loads are bounded by the rows per shard, rounded up for the first
``rows mod shards`` shards and down for the others: counts differ by one at most (law `rows`).
Documents are served in the order of a second hash, of id, size and checksum, so the result
depends on the rows alone, not on files or tasks, and a shard's slots are a shuffled order.

Which shards are open changes at most ``shards`` times while documents are served.  A document
is therefore placed by its arc of the ring and by the closing times before its turn alone.
The closing times are found exactly without moving rows: counts per arc and stretch of turns
tell in which stretch the next shard closes, and only that stretch is counted more finely,
until it holds a few thousand turns, which are served one by one.  The driver sees at most
``virtual * shards * CELLS`` counts at once, whatever the number of documents.

Defined results: a null text has no bytes, so its size is 1; a null id has a place like any
other; repeated rows have turns of their own, so even a table of one repeated row is spread
evenly; with fewer rows than shards some shards stay empty; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberscope.llm.tables import settled

SHARDS, VIRTUAL = 16, 32
CELLS = 256  # stretches of turns counted at once
SERVED = 4096  # turns that are served one by one
_PART = 40  # a turn is the number of its part, then its place there in so many bits


class Ring:
    """Arcs between virtual nodes, and for each arc all shards in the order they are met clockwise."""

    def __init__(self, shards: int, virtual: int):
        nodes = sorted((self.place(f"{s}:{v}"), s) for s in range(shards) for v in range(virtual))
        self.shards = shards
        self.places = np.array([p for p, _ in nodes], np.int64)
        owners = [s for _, s in nodes]
        self.clockwise = np.zeros((len(nodes), shards), np.int64)
        for arc in range(len(nodes)):
            met = dict.fromkeys(owners[arc:] + owners[:arc])
            self.clockwise[arc] = list(met)

    @staticmethod
    def place(name: str) -> int:
        return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little", signed=True)

    def arcs(self, places: np.ndarray) -> np.ndarray:
        """The arc of each place; beyond the last node the ring begins again."""
        return np.searchsorted(self.places, places) % len(self.places)

    def first_open(self, is_open: np.ndarray) -> np.ndarray:
        """For each arc the first shard clockwise that is open."""
        return self.clockwise[np.arange(len(self.places)), is_open[self.clockwise].argmax(axis=1)]


def capacities(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


class Closings:
    """Turns at which shards close, found from counts of ever shorter stretches."""

    def __init__(self, turns: DataFrame, ring: Ring):
        self.turns, self.ring = turns, ring
        first, last, rows = turns.agg(F.min("turn"), F.max("turn"), F.count(F.lit(1))).first()
        self.left = capacities(rows, ring.shards)
        self.after: list[int] = []  # from each of these turns on, the next row of ``targets`` holds
        self.targets: list[np.ndarray] = []
        self._changed(-1)
        if rows:
            self._serve(first, last, rows)

    def _changed(self, turn: int) -> None:
        """What holds after that turn."""
        is_open = self.left > 0
        if is_open.any():
            self.after.append(turn)
            self.targets.append(self.ring.first_open(is_open))

    def _serve(self, first: int, last: int, rows: int) -> None:
        between = self.turns.where(F.col("turn").between(first, last))
        if rows <= SERVED:
            for turn, arc in sorted(map(tuple, between.select("turn", "arc").collect())):  # at most SERVED rows
                shard = self.targets[-1][arc]
                self.left[shard] -= 1
                if not self.left[shard]:
                    self._changed(turn)
            return
        wide = -(-(last - first + 1) // CELLS)
        cell = F.expr(f"(turn - {first}L) div {wide}L")
        counted = between.groupBy(cell.alias("cell"), "arc").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("a"), F.max("turn").alias("b"))
        found = counted.toArrow().sort_by("cell")
        cells, arcs, n, a, b = (found[c].to_numpy() for c in ("cell", "arc", "n", "a", "b"))
        heads = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        for i, j in zip(heads, np.append(heads[1:], len(cells)), strict=True):
            load = np.bincount(self.targets[-1][arcs[i:j]], n[i:j], self.ring.shards).astype(np.int64)
            if (load > self.left).any():
                self._serve(int(a[i:j].min()), int(b[i:j].max()), int(n[i:j].sum()))
                continue
            closes = (self.left > 0) & (load == self.left)
            self.left -= load
            if closes.any():
                self._changed(int(b[i:j].max()))


def _turns(batches: Iterator[pa.RecordBatch], ring: Ring) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their arc, part and turn."""
    part = TaskContext.get().partitionId()
    done = 0
    for batch in batches:
        n = batch.num_rows
        columns = {c: batch.column(c) for c in ("doc_id", "size", "text_crc32")}
        columns["arc"] = pa.array(ring.arcs(batch.column("place").to_numpy()).astype(np.int32))
        columns["part"] = pa.array(np.full(n, part, np.int32))
        columns["turn"] = pa.array((part << _PART) + done + np.arange(n))
        done += n
        yield pa.RecordBatch.from_pydict(columns)


def _placed(batches: Iterator[pa.RecordBatch], after: np.ndarray, targets: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        period = np.searchsorted(after, batch.column("turn").to_numpy()) - 1
        shard = targets[period, batch.column("arc").to_numpy()].astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])


def sharded(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    ring = Ring(shards, virtual)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("string")).alias("place"),
    )
    keys = keys.withColumn("priority", F.xxhash64(F.lit("turn"), "doc_id", "size", "text_crc32"))
    keys = settled(keys.withColumn("row", F.monotonically_increasing_id()), "shard-keys")  # equal rows are told apart
    ordered = keys.repartitionByRange("priority", "row").sortWithinPartitions("priority", "row")
    id_type = dict(keys.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, size long, text_crc32 long, arc int, part int, turn long"
    turns = settled(ordered.mapInArrow(partial(_turns, ring=ring), schema), "shard-turns")

    found = Closings(turns.select("turn", "arc"), ring)
    after, targets = np.array(found.after), np.array(found.targets).reshape(-1, shards * virtual)
    placed = turns.mapInArrow(partial(_placed, after=after, targets=targets), f"{schema}, shard int")
    mine = Window.partitionBy("part", "shard").orderBy("turn")  # no more rows than a task has sorted
    placed = settled(placed.withColumn("_at", F.row_number().over(mine)), "shard-rows")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    offsets = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_before") + F.col("_at") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
