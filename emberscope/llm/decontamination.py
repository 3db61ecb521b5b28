"""Benchmark passages in training documents, found with spaced seeds.

A seed hashes the words of a window at the positions of a fixed mask and ignores the others.
The seven masks are chosen so that any aligned words that count as an overlap agree on one
whole seed: 80 of 100 equal in a whole item of 8 to 12 words or in a stretch of 13 to 25 (a
longer one has such a stretch in one of its halves).  An item of fewer than ``LEAST`` words has
one seed, all its words.  Seeds of the benchmark set bits of a filter of fixed size (8 MB);
the pass over the documents keeps only stretches around seeds that the filter lets through.
Those are joined with the benchmark's seeds by hash, which gives alignments of a stretch
with an item, and each alignment is verified word by word: it counts if it has a stretch of
13 words (or the whole item, if that is shorter) of which 80 of 100 are equal.  Reported is
the part of it from the first equal word to the last.

Words are lower-cased (A-Z).  Defined results: items and documents without words, or null,
match nothing; items of fewer than ``LEAST`` words count where all their words stand; rows that share an
id are one document or item; null ids are skipped; an empty table gives no hit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.kernels import U, Words, bytes_of, scrambled, slices
from emberscope.llm.tables import settled

STRETCH = 13
SHARE = 0.8
LEAST = 8
#: Fixed masks: word positions that count.  Whatever words ``SHARE`` lets differ leave one of them whole.
MASKS = (
    (0, 1, 2, 4, 5, 7), (0, 2, 3, 4, 5, 6), (0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 7, 8),
    (0, 1, 4, 5, 6, 8), (0, 1, 3, 6, 7, 8), (0, 1, 2, 3, 4, 5),
)
FILTER_BITS = 26
_AROUND = 2 * STRETCH - 1  # words kept on either side of a seed: the longest stretch that need not have a shorter one in it


def _seeds(words: Words, hashes: np.ndarray, lengths: Iterable[int], items: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word number and hash of every seed; ``lengths`` of short items make masks without gaps."""
    at, out = [], []
    left = np.repeat(words.bounds[1:], words.counts) - np.arange(len(words))
    size = np.repeat(words.counts, words.counts)
    for tag, mask in [*enumerate(MASKS, 1), *((100 + n, range(n)) for n in lengths)]:
        span = mask[-1] + 1
        there = left >= span
        if items:
            there &= size >= LEAST if tag < 100 else size == span
        starts = np.flatnonzero(there)
        total = np.full(len(starts), scrambled(np.array([tag], np.uint64))[0])
        for k in mask:
            total = scrambled(total + hashes[starts + k])
        at.append(starts)
        out.append(total)
    return np.concatenate(at), np.concatenate(out)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) to (item_id, words, seed_at, seeds): one row per item."""
    for batch in batches:
        for part in slices(batch, 1):
            words = Words(bytes_of(part.column(1)).lowered())
            hashes = words.hashes()
            at, seeds = _seeds(words, hashes, range(1, LEAST), True)
            order = np.lexsort((seeds, at))
            at, seeds = at[order], seeds[order]
            bounds = np.searchsorted(at, words.bounds)
            local = at - np.repeat(words.bounds[:-1], np.diff(bounds))
            columns = [
                part.column(0), pa.ListArray.from_arrays(pa.array(words.bounds.astype(np.int32)), pa.array(hashes.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(local)),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(seeds.view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "item_words", "seed_at", "seeds"])


def _probes(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = U((1 << FILTER_BITS) - 1)
    return seeds & low, (seeds >> U(32)) & low


def _filter(seeds: DataFrame) -> np.ndarray:
    """The bits that the seeds set, as 2^20 words of 64; what reaches the driver has that bound."""
    low = (1 << FILTER_BITS) - 1
    bits = seeds.select(F.explode(F.array(
        F.col("seed").bitwiseAND(F.lit(low)), F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(low))
    )).alias("bit"))
    word = F.shiftright("bit", 6).alias("word")
    mask = F.expr("shiftleft(1L, cast(bit & 63 AS int))")
    rows = bits.groupBy(word).agg(F.bit_or(mask).alias("mask")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return out


def _passes(seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    ok = np.ones(len(seeds), bool)
    for probe in _probes(seeds):
        ok &= (bits[(probe >> U(6)).astype(np.int64)] >> (probe & U(63)) & U(1)) == 1
    return ok


def _regions(batches: Iterator[pa.RecordBatch], bits: Broadcast, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to stretches of word hashes around seeds that pass the filter."""
    for batch in batches:
        for part in slices(batch, 1):
            words = Words(bytes_of(part.column(1)).lowered())
            hashes = words.hashes()
            at, seeds = _seeds(words, hashes, lengths)
            hit = _passes(seeds, bits.value)
            at, seeds = at[hit], seeds[hit]
            if not len(at):
                continue
            order = np.lexsort((seeds, at))
            at, seeds = at[order], seeds[order]
            text = words.text_of[at]
            new = np.ones(len(at), bool)
            new[1:] = (text[1:] != text[:-1]) | (at[1:] - at[:-1] > STRETCH + 2 * _AROUND)
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(at)) - 1
            owner = text[heads]
            start = np.maximum(at[heads] - _AROUND, words.bounds[owner])
            end = np.minimum(at[tails] + STRETCH + _AROUND, words.bounds[owner + 1])
            sizes = end - start
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            inner = np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[-1])
            hit_offsets = np.append(heads, len(at)).astype(np.int32)
            local = at - np.repeat(start, np.diff(hit_offsets))
            columns = [
                part.column(0).take(pa.array(owner)), pa.array(start - words.bounds[owner]),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes[inner].view(np.int64))),
                pa.ListArray.from_arrays(pa.array(hit_offsets), pa.array(local)),
                pa.ListArray.from_arrays(pa.array(hit_offsets), pa.array(seeds.view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "region_start", "region_words", "hit_at", "hits"])


def _longest(equal: np.ndarray) -> tuple[int, int] | None:
    """The longest stretch [a, b) with enough equal words; changed words may stand at its ends."""
    sums = np.concatenate([[0.0], np.cumsum(equal - SHARE)])
    least = np.minimum.accumulate(sums)
    a, best = 0, None
    most_after = np.maximum.accumulate(sums[::-1])[::-1]
    b = 0
    while a < len(sums) and b < len(sums):  # the widest a < b with sums[b] >= sums[a]
        if most_after[b] >= least[a] - 1e-9:
            if best is None or b - a > best[1] - best[0]:
                best = (a, b)
            b += 1
        else:
            a += 1
    if best is None or best[1] <= best[0]:
        return None
    return best


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignments to hits: doc_id, item_id, doc_start, item_start, n_words, n_equal."""
    for batch in batches:
        ids, items = batch.column(0).to_pylist(), batch.column(3).to_pylist()
        starts, shifts = batch.column(1).to_pylist(), batch.column(5).to_pylist()
        out = []
        for i in range(batch.num_rows):
            doc, item = (batch.column(k)[i].values.to_numpy() for k in (2, 4))
            shift = shifts[i]  # of the item's first word in the region
            low, high = max(0, -shift), min(len(item), len(doc) - shift)
            if high <= low or len(item) < LEAST and not np.array_equal(item, doc[low + shift : high + shift]):
                continue
            same = item[low:high] == doc[low + shift : high + shift]
            found = _longest(same)
            if found is None or found[1] - found[0] < min(STRETCH, len(item)):
                continue
            inside = found[0] + np.flatnonzero(same[found[0] : found[1]])  # reported from the first equal word to the last
            a, b = low + int(inside[0]), low + int(inside[-1]) + 1
            out.append((ids[i], items[i], starts[i] + a + shift, a, b - a, len(inside)))
        if out:
            types = [batch.schema.types[0], batch.schema.types[3], *[pa.int64()] * 4]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The best overlap of each document and benchmark item that have one.

    Columns doc_id, item_id, doc_start and item_start (word numbers), n_words, n_equal.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = settled(
        items.where("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(
            _item_seeds, "item_id long, item_words array<long>, seed_at array<long>, seeds array<long>"
        ).where(F.size("item_words") > 0).withColumn("item_key", F.xxhash64("item_id", "item_words")),
        "benchmark-seeds",
    )
    seeds = items.select("item_key", F.explode(F.arrays_zip("seed_at", "seeds")).alias("s")).select("item_key", F.col("s.seed_at").alias("seed_at"), F.col("s.seeds").alias("seed"))
    bits = spark.sparkContext.broadcast(_filter(seeds))
    lengths = [r[0] for r in items.select(F.size("item_words").alias("n")).where(F.col("n") < LEAST).distinct().collect()]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    regions = settled(
        texts.mapInArrow(
            partial(_regions, bits=bits, lengths=lengths), "doc_id long, region_start long, region_words array<long>, hit_at array<long>, hits array<long>"
        ).withColumn("region_key", F.xxhash64("doc_id", "region_start", "region_words")),
        "seeded-regions",
    )
    hits = regions.select("region_key", F.explode(F.arrays_zip("hit_at", "hits")).alias("h")).select("region_key", F.col("h.hit_at").alias("hit_at"), F.col("h.hits").alias("seed"))
    aligned = hits.join(seeds, "seed").select("region_key", "item_key", (F.col("hit_at") - F.col("seed_at")).alias("shift")).distinct()
    cases = aligned.join(regions.drop("hit_at", "hits"), "region_key").join(items.drop("seed_at", "seeds"), "item_key")
    found = cases.select("doc_id", "region_start", "region_words", "item_id", "item_words", "shift").mapInArrow(
        _verified, "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"
    )
    order = F.struct(F.col("n_equal"), -F.col("n_words"), -F.col("doc_start"), -F.col("item_start"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(order).alias("best"))
    return best.select(
        "doc_id", "item_id", (-F.col("best.col4")).alias("item_start"), (-F.col("best.col3")).alias("doc_start"),
        (-F.col("best.col2")).alias("n_words"), F.col("best.n_equal").alias("n_equal"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap, with all their columns; rows with a null id stay."""
    leaking = overlaps(docs, benchmark).select(F.col("doc_id").alias("_leaking")).distinct()
    return docs.join(leaking, docs["doc_id"] == leaking["_leaking"], "left_anti")
