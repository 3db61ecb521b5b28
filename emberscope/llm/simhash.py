"""SimHash near-duplicates through pigeonhole blocks.

Fingerprints are computed once per document; everything after works on distinct
fingerprints, so exact copies cost one row each.  The 64 bits are cut into six blocks: two
fingerprints with at most four differing bits agree on two whole blocks, so every such pair
meets in one of the 15 tables keyed by two blocks.  Inside a bucket the Hamming distance is
verified and only a spanning set of links leaves, never all pairs.  A bucket with more than
``BUCKET`` fingerprints is dealt out again: the bits that vary in it are cut into five
blocks, of which a close pair shares one; this ends because few varying bits leave few
distinct fingerprints.

``near_duplicates`` keeps to 64 bits of 4-word shingles and four differing bits.
``similar_documents`` links documents that share 80 of 100 distinct 5-word shingles.  Their
SimHash has 768 bits in 32 blocks of 24: documents that agree in a block meet, and those at
most ``LONG_DISTANCE`` bits apart become candidates.  At that similarity a bit differs in 15 %
of cases and a pair agrees in a block in 47 %, at 0.9 in 91 %, at 0.95 in 99.7 %, so blocks
alone would lose pairs near the limit, and more of them would meet by chance in a large
corpus.  As an extra, documents that agree in one of 40 bands of six minima are candidates too:
that misses a pair at 0.8 once in 190,000.  A bucket leaves one link to its first member, made
before the shuffle where its members are in one batch, so nothing of it is held and a value
that most documents share reaches its task once a batch.  What candidates connect is a group;
inside a group all pairs are compared by exact Jaccard of their sets of 64-bit shingle hashes.
A group of more than ``CELL`` shingles is dealt into parts, and every two parts meet in a cell
of their own.

Defined results: no word (null, empty) gives fingerprint zero, linked like any other; rows
with one id are one document; a null id takes part but never names a component; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope.llm.components import components
from emberscope.llm.decontamination import _filter, _passes
from emberscope.llm.kernels import Bytes, U, Words, bytes_of, joined, scrambled, slices, window_hashes
from emberscope.llm.tables import settled

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCK_WIDTHS = (11, 11, 11, 11, 10, 10)
BUCKET = 4096
_FEW = 8  # runs up to this long are compared pair by pair in one vectorised sweep


def fingerprints_of(of: Bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One 64-bit SimHash per text."""
    words = Words(of.lowered())
    data, start, end = joined(words)
    data = data.tobytes()
    n_shingles = np.where(words.counts > 0, np.maximum(words.counts - size + 1, 1), 0)
    first = np.repeat(words.bounds[:-1] - np.concatenate([[0], np.cumsum(n_shingles)[:-1]]), n_shingles)
    first = first + np.arange(len(first))
    last = np.minimum(first + size - 1, np.repeat(words.bounds[1:], n_shingles) - 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(start[first].tolist(), end[last].tolist(), strict=True)
    hashes = np.fromiter((digest(data[a:b], seed) for a, b in spans), np.dtype("<u8"), len(first))
    out = np.zeros(len(of), np.uint64)
    some = np.flatnonzero(n_shingles)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.concatenate([[0], np.cumsum(n_shingles[some])[:-1]])
        counts = np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        over = 2 * counts > n_shingles[some][:, None]
        out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            prints = fingerprints_of(bytes_of(part.column(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; no shuffle."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", narrow.schema[0].dataType), T.StructField("fp", T.LongType())])
    return narrow.mapInArrow(_fingerprint_batches, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> list[int]:
    """The bits of every two blocks."""
    blocks, at = [], 0
    for width in BLOCK_WIDTHS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [_signed(a | b) for i, a in enumerate(blocks) for b in blocks[i + 1 :]]


def _cut(varying: int) -> list[int]:
    """Those bits in five parts."""
    bits = [i for i in range(64) if varying >> i & 1]
    return [_signed(sum(1 << b for b in bits[k :: DISTANCE + 1])) for k in range(DISTANCE + 1)]


def _dealt(prints: DataFrame) -> list[DataFrame]:
    """(mask, key, fp) rows whose buckets hold at most ``BUCKET`` fingerprints."""
    masks = F.array(*[F.lit(m).cast("long") for m in _masks()])
    rows = prints.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    cut = F.udf(lambda v: _cut(v & (1 << 64) - 1), T.ArrayType(T.LongType()))  # on large buckets only: a small table
    done = []
    while True:
        large = settled(
            rows.groupBy("mask", "key")
            .agg(F.count(F.lit(1)).alias("n"), F.bit_or("fp").alias("any"), F.bit_and("fp").alias("all"))
            .where(F.col("n") > BUCKET)
            .select("mask", "key", cut(F.col("any").bitwiseAND(F.bitwise_not("all"))).alias("parts")),
            "large-buckets",
        )
        if large.isEmpty():
            return [*done, rows]
        done.append(rows.join(large, ["mask", "key"], "left_anti"))
        finer = rows.join(large, ["mask", "key"]).select("fp", "mask", F.explode("parts").alias("part"))
        finer = finer.select("fp", F.col("mask").bitwiseOR(F.col("part")).alias("mask"))
        rows = settled(finer.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct(), "finer-buckets")


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE


def _spanning(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in one bucket, by visiting neighbours."""
    left, links = prints, []
    while len(left):
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for x in front:
                near |= _close(left, x)
            front, left = left[near], left[~near]
            links.append((front, np.full(len(front), root)))
    if not links:
        return prints[:0], prints[:0]
    return np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (mask, key); a run is one bucket."""
    held = [np.zeros(0, np.int64)] * 3

    def of(mask, key, prints):
        n = len(prints)
        head = np.ones(n, bool)
        head[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
        heads = np.flatnonzero(head)
        sizes = np.diff(np.append(heads, n))
        run = np.repeat(np.arange(len(heads)), sizes)
        out = []
        few = sizes[run] <= _FEW
        for k in range(1, _FEW):
            i = np.flatnonzero(few[:-k] & (run[k:] == run[:-k])) if n > k else np.zeros(0, int)
            i = i[_close(prints[i], prints[i + k])]
            out.append((prints[i + k], prints[i]))
        out += [_spanning(prints[h : h + s]) for h, s in zip(heads, sizes, strict=True) if s > _FEW]
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
        if not len(rows[0]):
            continue
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        last = int(np.argmax(same))  # the run that may go on in the next batch
        held = [r[last:] for r in rows]
        if last:
            yield of(*[r[:last] for r in rows])
    if len(held[0]):
        yield of(*held)


def links(prints: DataFrame) -> DataFrame:
    """(a, b) fingerprints at most four bits apart that connect all such pairs.

    ``prints`` has distinct fingerprints ``fp``.
    """
    out = None
    for rows in _dealt(prints):
        ordered = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
        found = ordered.mapInArrow(_links, "a long, b long")
        out = found if out is None else out.union(found)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint and component_id, the smallest id linked to it."""
    prints = settled(fingerprints(docs), "fingerprints")
    distinct = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp")), "fingerprint-links").select(F.col("node").alias("fp"), "root")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.join(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named.select("fp", "component_id"), "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


LONG_SHINGLE = 5
BANDS = 40
BAND_ROWS = 6
CELL = 1 << 19  # shingles of the sets that one part of a group holds on average
_FACTORS = scrambled(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | U(1)
_SHIFTS = scrambled(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) + U(1 << 32))
LONG_WORDS = 12  # of 64 bits each
LONG_BLOCK = 3  # bytes
LONG_DISTANCE = 160  # of 768 bits: sets shared to 0.8 differ in 116 on average, spread 10; strangers in 384
_LANES = np.uint64(0x0101010101010101)
_LANE_ROWS = 255  # rows that eight-bit lanes can add up


def _set_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes the bits set in over half of them; every run has one at least."""
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    chunks = -(-sizes // _LANE_ROWS)
    inner = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    starts = np.repeat(heads, chunks) + inner * _LANE_ROWS
    runs = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    out = np.zeros(len(sizes), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
        over = 2 * np.add.reduceat(lanes, runs, axis=0, dtype=np.int64) > sizes[:, None]
        out |= np.ascontiguousarray(over.astype(np.uint8)).view("<u8").ravel() << np.uint64(bit)
    return out


def _shingles(of: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles (fewer words: all of them) by text, and the text of each."""
    words = Words(of.lowered())
    hashes, counts = words.hashes(), words.counts
    starts = words.window_starts(LONG_SHINGLE)
    shingles, owners = [window_hashes(hashes, LONG_SHINGLE)[starts]], [words.text_of[starts]]
    for few in range(1, LONG_SHINGLE):
        texts = np.flatnonzero(counts == few)
        shingles.append(window_hashes(hashes, few)[words.bounds[texts]])
        owners.append(texts)
    shingle, owner = np.concatenate(shingles), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return shingle[order], owner[order]


def long_fingerprints(shingle: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``LONG_WORDS`` 64-bit words of SimHash for each run of shingles."""
    return np.stack([_set_bits(scrambled(shingle + U(k + 1)), sizes) for k in range(LONG_WORDS)], axis=1)


def _block_keys(prints: np.ndarray) -> np.ndarray:
    """Number and bits of each block of the fingerprints."""
    octets = np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1, LONG_BLOCK).astype(np.int64)
    return octets @ (1 << 8 * np.arange(LONG_BLOCK)) + (np.arange(octets.shape[1]) << 8 * LONG_BLOCK)


def _sets(of: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text, the range of each text, and a hash of each text's set."""
    shingle, owner = _shingles(of)
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, sizes = shingle[new], np.bincount(owner[new], minlength=len(of))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scrambled(shingle + U(1)))])
    return shingle, bounds, scrambled(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64))


def _band_keys(shingle: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """One hash per band and run of shingles; two sets agree in a minimum as often as they are similar."""
    out = np.empty((len(heads), BANDS), np.uint64)
    for band in range(BANDS):
        total = np.full(len(heads), U(band + 1))
        for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            total = scrambled(total + np.minimum.reduceat(shingle * _FACTORS[k] + _SHIFTS[k], heads))
        out[:, band] = total
    return out


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, node, keys, prints); a text without words has none of the last two."""
    for batch in batches:
        for part in slices(batch, 1, 1 << 20):
            shingle, bounds, node = _sets(bytes_of(part.column(1)))
            some = bounds[:-1] < bounds[1:]
            keys, prints = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            if some.any():
                keys = _band_keys(shingle, bounds[:-1][some]).ravel()
                prints = long_fingerprints(shingle, np.diff(bounds)[some]).ravel()
            columns = [part.column(0), pa.array(node.view(np.int64))]
            for values, width in ((keys, BANDS), (prints, LONG_WORDS)):
                offsets = np.concatenate([[0], np.cumsum(some * width)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "keys", "prints"])


def _met(batches: Iterator[pa.RecordBatch], blocks: bool) -> Iterator[pa.RecordBatch]:
    """(node, values) to (key, node, first): the first node of a key in a batch, which goes on to
    the key's bucket (``first`` null), and links of the others to it."""
    for batch in batches:
        node, column = batch.column(0).to_numpy(), batch.column(1)
        values = column.flatten().to_numpy()
        if not len(values):
            continue
        if blocks:
            prints = values.view(np.uint64).reshape(-1, LONG_WORDS)
            key, width = _block_keys(prints).ravel(), LONG_WORDS * 8 // LONG_BLOCK
        else:
            key, width = values, BANDS
        node = np.repeat(node[column.value_lengths().to_numpy() > 0], width)
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        head = np.append(True, key[1:] != key[:-1])
        first = np.repeat(node[head], np.diff(np.append(np.flatnonzero(head), len(key))))
        rest = ~head & (node != first)
        links = np.unique(np.stack([node[rest], first[rest]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(key[head]), pa.array(node[head]), pa.nulls(int(head.sum()), pa.int64())], ["key", "node", "first"])
        yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[0]), pa.array(links[1])], ["key", "node", "first"])


def _to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_met`` sorted by key: its links, and each node of a bucket with the bucket's first."""
    last = None
    for batch in batches:
        made = batch.filter(batch.column(2).is_valid())
        yield pa.RecordBatch.from_arrays([made.column(1), made.column(2)], ["a", "b"])
        left = batch.filter(batch.column(2).is_null())
        if not left.num_rows:
            continue
        key, node = left.column(0).to_numpy(), left.column(1).to_numpy()
        if last is not None:
            key, node = np.append(last[0], key), np.append(last[1], node)
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        first = np.repeat(node[heads], np.diff(np.append(heads, len(key))))
        last = key[-1], first[-1]
        i = np.flatnonzero(node != first)
        yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(first[i])], ["a", "b"])


def _candidates(distinct: DataFrame, values: str, blocks: bool) -> DataFrame:
    """(a, b) nodes: links to the first of each bucket."""
    met = distinct.select("node", values).mapInArrow(partial(_met, blocks=blocks), "key long, node long, first long")
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(_to_first, "a long, b long")


def block_candidates(distinct: DataFrame) -> DataFrame:
    """(a, b) nodes that share a block of their fingerprints and are at most ``LONG_DISTANCE`` bits apart."""
    prints = distinct.select("node", "prints")
    pairs = _candidates(distinct, "prints", True).distinct()
    pairs = pairs.join(prints.select(F.col("node").alias("a"), F.col("prints").alias("_a")), "a")
    pairs = pairs.join(prints.select(F.col("node").alias("b"), F.col("prints").alias("_b")), "b")
    apart = sum((F.bit_count(F.col("_a")[k].bitwiseXOR(F.col("_b")[k])) for k in range(LONG_WORDS)), F.lit(0))
    return pairs.where(apart <= LONG_DISTANCE).select("a", "b")


def _set_batches(batches: Iterator[pa.RecordBatch], bits: Broadcast) -> Iterator[pa.RecordBatch]:
    """Texts to (node, shingles) for the nodes that pass the filter, each once a task."""
    seen = np.zeros(0, np.uint64)
    for batch in batches:
        for part in slices(batch, 0, 1 << 20):
            shingle, bounds, node = _sets(bytes_of(part.column(0)))
            _, first = np.unique(node, return_index=True)
            first = first[_passes(node[first], bits.value) & ~np.isin(node[first], seen)]
            seen = np.append(seen, node[first])
            for i in np.array_split(first, max(1, len(first) // 256)):
                sizes = bounds[i + 1] - bounds[i]
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                inner = np.repeat(bounds[i] - offsets[:-1], sizes) + np.arange(offsets[-1])
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(shingle[inner].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node[i].view(np.int64)), sets], ["node", "shingles"])


def _spanning_sets(node: np.ndarray, sizes: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what sets shared to 0.8 connect in one cell, by visiting neighbours."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(sizes, kind="stable")
    kinds, ids = np.unique(shingle, return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(sizes[order])])
    ids = ids[np.repeat(bounds[order] - offsets[:-1], sizes[order]) + np.arange(offsets[-1])]
    node, sizes = node[order], sizes[order]
    mark, alone = np.zeros(len(kinds), bool), np.ones(len(node), bool)
    n_alone, out = len(node), [(node[:0], node[:0])]
    for root in range(len(node)):
        if not alone[root]:
            continue
        alone[root] = False
        front, n_alone = [root], n_alone - 1
        while front and n_alone:
            x = front.pop()
            low = np.searchsorted(sizes, -(-4 * sizes[x] // 5))
            high = np.searchsorted(sizes, 5 * sizes[x] // 4, side="right")
            mine = ids[offsets[x] : offsets[x + 1]]
            mark[mine] = True
            shared = np.add.reduceat(mark[ids[offsets[low] : offsets[high]]], offsets[low:high] - offsets[low], dtype=np.int64)
            mark[mine] = False
            near = low + np.flatnonzero(alone[low:high] & (9 * shared >= 4 * (sizes[low:high] + sizes[x])))
            alone[near] = False
            n_alone -= len(near)
            front += near.tolist()
            out.append((node[near], np.full(len(near), node[root])))
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, node, shingles) sorted by cell; a run is one cell."""
    held: list[pa.RecordBatch] = []

    def of():
        column = pa.chunked_array([h.column(2) for h in held]).combine_chunks()
        node = np.concatenate([h.column(1).to_numpy() for h in held])
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = _spanning_sets(node, sizes, column.flatten().to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(0).to_numpy()
        heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        for h, n in zip(heads, np.diff(np.append(heads, len(cell))), strict=True):
            if held and held[0].column(0)[0].as_py() != cell[h]:
                yield of()
                held = []
            held.append(batch.slice(h, n))
    if held:
        yield of()


def _exact_links(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b) nodes that connect all sets shared to 0.8 inside each group (node, root)."""
    bits = texts.sparkSession.sparkContext.broadcast(_filter(groups.select(F.col("node").alias("seed"))))
    sets = texts.select("text").mapInArrow(partial(_set_batches, bits=bits), "node long, shingles array<long>")
    members = settled(sets.join(groups, "node").dropDuplicates(["node"]), "grouped-sets")
    parts = members.groupBy("root").agg(F.ceil(F.sum(F.size("shingles")) / F.lit(CELL)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    met = members.join(parts, "root").withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = met.select(F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "node", "shingles")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links, "a long, b long")


def similar_documents(docs: DataFrame) -> DataFrame:
    """Per document component_id, the smallest id it is linked to by shingles shared to 0.8."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_field = T.StructField("doc_id", narrow.schema[0].dataType)
    schema = T.StructType([id_field, *T.StructType.fromDDL("node long, keys array<long>, prints array<long>")])
    prints = settled(narrow.mapInArrow(_band_batches, schema), "shingle-prints")
    distinct = prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"), F.first("prints").alias("prints"))
    distinct = settled(distinct, "distinct-sets")
    met = block_candidates(distinct).union(_candidates(distinct, "keys", False))
    groups = settled(components(met, "candidate-links"), "candidate-groups")
    roots = components(_exact_links(narrow, groups), "similar-links").withColumnRenamed("node", "linked")
    placed = distinct.join(roots, F.col("node") == F.col("linked"), "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    return prints.select("doc_id", "node").join(named.select("node", "component_id"), "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id among those they are similar to, with all their columns.
    Rows with a null id stay; rows that share an id stay or go together."""
    gone = similar_documents(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
