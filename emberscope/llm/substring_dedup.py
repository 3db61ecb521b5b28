"""Removal of repeated passages through difference-cover anchors.

Positions of a document are taken modulo 13, and 8-word anchors are hashed only at the
residues 0, 1, 3 and 9.  The differences of these four reach every residue, so two equal
20-word windows, wherever they start, share an anchor at one offset of at most 12 that is a
cover position in both.  Hence only windows around an anchor that two documents have can
repeat across documents; those are extended to the full 20 words, hashed with 96 bits, and
the smallest document that holds a window keeps it.

1. one pass emits the distinct anchors of each document; what several documents of a stretch
   share leaves it as one row for the shuffle and as settled rows for the others;
2. anchors met from two documents go back to their documents;
3. windows around them are compared, combined in the same way;
4. one pass marks the words and writes what is left.

Exact copies need no windows: a text that a smaller id has goes whole.

Defined results: ids are longs; a null text has no words; rows that share an id count as one
document and never hide each other; rows with a null id lose only what repeats inside them;
an empty table gives an empty result; inside one document windows are compared by 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope.llm.kernels import Words, bytes_of, joined_texts, later_twins, lists_of, members, scrambled, slices, window_hashes

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

_SLICE, _COMBINED = 1 << 20, 6 << 20  # bytes of text at a time, and combined before a shuffle
_IS_COVER = np.isin(np.arange(PERIOD), COVER)
_OPEN, _SETTLED = 0, 2  # to be compared further; decided
_SHARED = 1  # to be compared further, and known to be shared


def _salt(n: int) -> np.ndarray:
    return scrambled(np.arange(n, dtype=np.uint64) + np.uint64(77))


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, text number and hash of each anchor (48 bits: a chance match only costs a look)."""
    at = words.window_starts(ANCHOR)
    text = words.text_of[at]
    cover = _IS_COVER[(at - words.bounds[text]) % PERIOD]
    at, text = at[cover], text[cover]
    return at, text, window_hashes(words.hashes(), ANCHOR)[at] >> np.uint64(16)


def _pairs(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, id) sorted, and whether the key is the previous row's."""
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    fresh = np.ones(len(key), bool)
    fresh[1:] = ~same[1:] | (ids[1:] != ids[:-1])
    key, ids = key[fresh], ids[fresh]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    return key, ids, same


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    """Stretches of a batch that are combined before the shuffle, each cut into slices."""
    for batch in batches:
        for group in slices(batch, 1, _COMBINED):
            yield slices(group, 1, _SLICE)


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        keys, owners = [], []
        for part in group:
            _, text, hashes = _anchors(Words(bytes_of(part.column(1))))
            keys.append(hashes)
            owners.append(part.column(0).to_numpy()[text])
        if not keys:
            continue
        key, ids, same = _pairs(np.concatenate(keys), np.concatenate(owners))
        shared = np.append(same[1:], False)
        kind = np.where(same, _SETTLED, np.where(shared, _SHARED, _OPEN)).astype(np.int8)
        columns = [pa.array(key.view(np.int64)), pa.array(ids), pa.array(kind)]
        yield pa.RecordBatch.from_arrays(columns, ["hash", "doc_id", "kind"])


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash; the last row waits for the next batch."""
    held = None
    before = None  # the hash before the held rows

    def chosen(rows, previous, following):
        key, ids, kind = rows
        equal = np.zeros(len(key), bool)
        equal[1:] |= key[1:] == key[:-1]
        equal[:-1] |= key[1:] == key[:-1]
        equal[0] |= previous is not None and key[0] == previous
        equal[-1] |= following is not None and key[-1] == following
        pick = equal | (kind != _OPEN)
        return pa.RecordBatch.from_arrays([pa.array(ids[pick]), pa.array(key[pick])], ["doc_id", "hash"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy() for c in batch.columns]
        if held is not None:
            yield chosen(held, before, rows[0][0])
            before = held[0][-1]
        held = rows
    if held is not None:
        yield chosen(held, before, None)


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, shared hashes, hashes of copied texts."""
    for group in _groups(batches):
        out = []
        for part in group:
            ids = part.column(0).to_numpy()
            words = Words(bytes_of(part.column(1)))
            copied = _copied(part)
            row, shared = lists_of(part.column(2))
            salt = _salt(len(ids))
            at, text, hashes = _anchors(words)
            hit = members(hashes ^ salt[text], shared.view(np.uint64) ^ salt[row]) & ~copied[text]
            marks = np.zeros(len(words) + PERIOD + 1, np.int64)
            marks[at[hit] + 1] = 1
            marks = np.cumsum(marks)
            starts = words.window_starts(WINDOW)
            starts = starts[marks[starts + PERIOD] > marks[starts]]
            word_hashes = words.hashes()
            one, two = (window_hashes(word_hashes, WINDOW, k)[starts] for k in (0, 1))
            two >>= np.uint64(32)
            out.append((one, two, ids[words.text_of[starts]]))
        if not out:
            continue
        one, two, ids = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((ids, two, one))
        one, two, ids = one[order], two[order], ids[order]
        same = np.zeros(len(one), bool)
        same[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        fresh = ~same
        fresh[1:] |= ids[1:] != ids[:-1]
        kind = np.where(same, _SETTLED, _OPEN).astype(np.int8)
        columns = [one.view(np.int64), two.view(np.int64), ids, kind]
        yield pa.RecordBatch.from_arrays([pa.array(c[fresh]) for c in columns], ["one", "two", "doc_id", "kind"])


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by both hashes and id; (doc_id, one) of those that a smaller id has too."""
    last = None  # hashes and smallest id of the window that the previous batch ended with
    for batch in batches:
        one, two, ids, kind = (c.to_numpy() for c in batch.columns)
        settled = kind == _SETTLED
        done = (ids[settled], one[settled])
        one, two, ids = (x[~settled] for x in (one, two, ids))
        later = np.zeros(len(one), bool)
        if len(one):
            head = np.ones(len(one), bool)
            head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            goes_on = last is not None and last[:2] == (one[0], two[0])
            first = np.flatnonzero(head)
            smallest = ids[first]
            if goes_on:
                smallest[0] = last[2]
            later = ids > np.repeat(smallest, np.diff(np.append(first, len(one))))
            last = (one[-1], two[-1], smallest[-1])
        columns = [np.concatenate([done[0], ids[later]]), np.concatenate([done[1], one[later]])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "hash"])


def _copied(part: pa.RecordBatch) -> np.ndarray:
    """Which rows' text is listed in the last column."""
    lists = part.column(part.num_columns - 1).to_pylist()
    out = np.zeros(part.num_rows, bool)
    for i, listed in enumerate(lists):
        if listed:
            text = part.column(1)[i].as_py()
            out[i] = text is not None and hashlib.md5(text.encode()).digest() in listed
    return out


def _finish(batches: Iterator[pa.RecordBatch], untouched: bool) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, carried ones, hashes of removed windows, hashes of copied texts.

    ``untouched``: a text that loses nothing stays as it is, with its own spacing.
    """
    for batch in batches:
        for part in slices(batch, 1, _SLICE):
            words = Words(bytes_of(part.column(1)))
            salt = _salt(part.num_rows)
            starts = words.window_starts(WINDOW)
            text = words.text_of[starts]
            keys = window_hashes(words.hashes(), WINDOW)[starts] ^ salt[text]
            row, hashes = lists_of(part.column(part.num_columns - 2))
            gone = _copied(part)[text]
            gone |= members(keys, hashes.view(np.uint64) ^ salt[row])
            gone |= later_twins(keys)
            edges = np.zeros(len(words) + WINDOW + 1, np.int64)
            np.add.at(edges, starts[gone], 1)
            np.subtract.at(edges, starts[gone] + WINDOW, 1)
            keep = np.cumsum(edges[: len(words)]) == 0
            kept = np.bincount(words.text_of[keep], minlength=part.num_rows)
            counts = [pa.array(words.counts), pa.array(words.counts - kept)]
            left = joined_texts(words, keep)
            if untouched:
                left = pc.if_else(pa.array(kept == words.counts), part.column(1), left)
            columns = [part.column(0), *part.columns[2:-2], *counts, left]
            names = [part.schema.names[0], *part.schema.names[2:-2], *_RESULT]
            yield pa.RecordBatch.from_arrays(columns, names)


_RESULT = ("_n_words", "_n_removed", "_kept")


def _spread(key: str):
    """Rows to be compared meet by hash; settled ones go anywhere."""
    return F.when(F.col("kind") == _SETTLED, F.xxhash64(key, "doc_id")).otherwise(F.col(key))


def _stripped(docs: DataFrame, carry: list[str], untouched: bool) -> DataFrame:
    """(_id, carried columns, _n_words, _n_removed, _kept) per row."""
    carried = [F.col(f"`{c}`") for c in carry]
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), *carried)
    named = texts.where("_id IS NOT NULL")
    only = named.select(F.col("_id").alias("doc_id"), F.col("_text").alias("text"))

    anchors = only.mapInArrow(_emit_anchors, "hash long, doc_id long, kind byte")
    met = anchors.repartition(_spread("hash")).sortWithinPartitions("hash")
    shared = met.mapInArrow(_shared_anchors, "doc_id long, hash long")

    digests = only.where("text IS NOT NULL").select("doc_id", F.unhex(F.md5("text")).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = digests.join(first, "digest").where("doc_id > first").select("doc_id", "digest").distinct()
    no_digest, no_hash = F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("hash")

    def by_document(hashes: DataFrame) -> DataFrame:
        rows = hashes.select("doc_id", "hash", no_digest).union(copies.select("doc_id", no_hash, "digest"))
        lists = rows.groupBy("doc_id").agg(F.collect_list("hash").alias("_hashes"), F.collect_list("digest").alias("_digests"))
        return lists.withColumnRenamed("doc_id", "_owner")

    around = by_document(shared)
    held = named.join(around, named["_id"] == around["_owner"]).where(F.size("_hashes") > 0)
    windows = held.select(F.col("_id").alias("doc_id"), F.col("_text").alias("text"), "_hashes", "_digests").mapInArrow(
        _emit_windows, "one long, two long, doc_id long, kind byte"
    )
    ordered = windows.repartition(_spread("one")).sortWithinPartitions("one", "two", "doc_id")
    later = by_document(ordered.mapInArrow(_later_windows, "doc_id long, hash long"))

    judged = named.join(later, named["_id"] == later["_owner"], "left").drop("_owner")
    alone = texts.where("_id IS NULL").select(
        "*", F.lit(None).cast("array<long>").alias("_hashes"), F.lit(None).cast("array<binary>").alias("_digests")
    )
    rows = judged.union(alone)
    schema = T.StructType([rows.schema[0], *rows.schema[2:-2], *T.StructType.fromDDL(f"{_RESULT[0]} long, {_RESULT[1]} long, {_RESULT[2]} string")])
    return rows.mapInArrow(partial(_finish, untouched=untouched), schema)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the words that stay, one space between them."""
    out = _stripped(docs, [], False)
    return out.select(F.col("_id").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept_text"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated passages cut out.

    A document that loses words gets its kept words as text and its new length as n_chars
    (where it has that column); one that loses all words goes; others stay as they are.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = _stripped(docs, carry, True).where("_n_removed = 0 OR _n_removed < _n_words")
    new = {"doc_id": F.col("_id"), "text": F.col("_kept")}
    if "n_chars" in docs.columns:
        length = F.when(F.col("_n_removed") > 0, F.length("_kept")).otherwise(F.col("n_chars"))
        new["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
