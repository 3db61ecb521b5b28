"""Numpy helpers that turn a batch of texts into words, hashes and windows.

Spark cuts, shuffles and retries the work; inside a task these functions see one small
slice of a batch (``slices``), so their memory is bounded by ``SLICE_BYTES`` or by the one
document that is longer.  Words are runs of bytes other than space and tab to carriage
return, which is the same on UTF-8 bytes as on characters.

Hashes are sums of byte codes times powers of an odd number, modulo 2^64, taken from one
running sum; a word's 64 bits are scrambled, and windows combine the words' hashes in two
independent ways where 128 bits are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

U = np.uint64
_BASE = U(0x9E3779B97F4A7C13)  # odd
_WINDOW_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)  # odd
_ALL = (1 << 64) - 1

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_CODES = scrambled(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=1)
def _powers(log_size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i below 2^log_size."""
    n = 1 << log_size
    inverse = U(pow(int(_BASE), -1, 1 << 64))
    out = []
    for step in (_BASE, inverse):
        powers = np.full(n, step, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        out.append(powers)
    return out[0], out[1]


class Bytes:
    """The bytes of some texts, one after the other; text i is [offsets[i], offsets[i+1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> "Bytes":
        return Bytes(_LOWER[self.data], self.offsets)

    def running_hash(self) -> np.ndarray:
        n = len(self.data)
        powers, _ = _powers(max(22, n.bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[self.data] * powers[:n], out=sums[1:])
        return sums

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits for each byte span; equal spans have equal hashes wherever they lie."""
        return self.hash_between(self.running_hash(), start, end)

    def hash_between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same from a running hash that is at hand."""
        _, back = _powers(max(22, len(self.data).bit_length()))
        return scrambled((sums[end] - sums[start]) * back[start])


def bytes_of(texts: pa.Array) -> Bytes:
    """Null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None:
        return Bytes(np.zeros(0, np.uint8), at - at[0])
    return Bytes(np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0])


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of text; a longer text comes alone."""
    n = batch.num_rows
    if not n:
        return
    ends = bytes_of(batch.column(column)).offsets
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a batch: byte spans, and the range of word numbers of each text."""

    def __init__(self, of: Bytes, inside: np.ndarray | None = None):
        """``inside`` marks the bytes of words, where they are others than the usual ones."""
        data, offsets = of.data, of.offsets
        self.of = of
        n = len(data)
        inside = ~_SEPARATOR[data] if inside is None else inside
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            full = offsets[:-1] < offsets[1:]
            heads, tails = offsets[:-1][full], offsets[1:][full] - 1
            first[heads] = inside[heads]
            last[tails] = inside[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of)), self.counts)

    def hashes(self) -> np.ndarray:
        return self.of.span_hashes(self.start, self.end)

    def window_starts(self, size: int) -> np.ndarray:
        """Word numbers at which ``size`` words of one text begin."""
        left = np.repeat(self.bounds[1:], self.counts) - np.arange(len(self))
        return np.flatnonzero(left >= size)


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """The hash of ``size`` words from each word on (wrong at the last ``size`` - 1), by doubling."""
    base = _WINDOW_BASES[which]
    total = np.zeros(len(words), np.uint64)
    block, length, factor, done, shift = words, 1, base, 0, 1
    while True:
        if size & length:
            part = np.zeros_like(total)
            part[: len(words) - done] = block[done:] if done else block
            total += part * U(shift)
            shift = shift * factor & _ALL
            done += length
        if done == size:
            return scrambled(total + U(which))
        later = np.zeros_like(block)
        if length < len(block):
            later[:-length] = block[length:]
        block = block + later * U(factor)
        length, factor = 2 * length, factor * factor & _ALL


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def joined(words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept words with one space after each, and the start and end of each word there."""
    start, end = (words.start, words.end) if keep is None else (words.start[keep], words.end[keep])
    at = np.concatenate([[0], np.cumsum(end - start + 1)])
    source = np.repeat(start - at[:-1], end - start + 1) + np.arange(at[-1])
    out = np.append(words.of.data, np.uint8(32))[source]
    out[at[1:] - 1] = 32
    return out, at[:-1], at[1:] - 1


def joined_texts(words: Words, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, one space between them."""
    data, start, end = joined(words, keep)
    kept = per_text(keep, words.bounds)
    after = np.cumsum(kept)
    some = kept > 0
    inner = np.ones(len(data), bool)
    inner[end[after[some] - 1]] = False  # the space after a text's last word
    ends = np.zeros(len(kept) + 1, np.int64)
    ends[1:][some] = end[after[some] - 1] - np.arange(some.sum())
    offsets = np.maximum.accumulate(ends)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[inner])]
    return pa.LargeStringArray.from_buffers(len(kept), *buffers[1:]).cast(pa.string())


def members(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys occur among the others."""
    if not len(among):
        return np.zeros(len(keys), bool)
    among = np.sort(among)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys


def later_twins(keys: np.ndarray) -> np.ndarray:
    """Which values equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    again = np.zeros(len(keys), bool)
    again[order[1:]] = ranked[1:] == ranked[:-1]
    return again


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row number and the value of each entry of a column of long arrays; null rows have none."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), sizes), values


_NONE = U(_ALL)


class HashRows:
    """Row numbers by 64-bit key (any but all ones), for whole arrays of keys; at most half full."""

    def __init__(self, rows: int):
        self.bits = max(4, (2 * rows).bit_length())
        self.keys = np.full(1 << self.bits, _NONE, np.uint64)
        self.rows = np.zeros(1 << self.bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> U(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Distinct keys that are not here yet."""
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            trying = left[self.keys[slot[left]] == _NONE]
            _, first = np.unique(slot[trying], return_index=True)
            placed = trying[first]
            self.keys[slot[placed]], self.rows[slot[placed]] = keys[placed], rows[placed]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        left, slot, asked = None, self._slots(keys), keys
        while len(asked):
            there = self.keys[slot]
            hit = there == asked
            if left is None:
                out[hit] = self.rows[slot[hit]]
            else:
                out[left[hit]] = self.rows[slot[hit]]
            further = np.flatnonzero(~hit & (there != _NONE))
            left = further if left is None else left[further]
            asked, slot = asked[further], (slot[further] + 1) & (len(self.keys) - 1)
        return out
