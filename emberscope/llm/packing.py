"""Packing of documents into sequences along a space-filling curve.

Documents are tokenized once and written with a Hilbert key: the mean of fixed random vectors
of their token ids, in four dimensions, quantized to 15 bits each.  Rows are range-sorted by
that key, so neighbours on the curve are documents with similar tokens; equal keys are told
apart by the id, so a large group of copies spreads over tasks.  Every range is packed from
end to end: a document goes on in the next sequence where one is full, and what remains at
the end of a range is cut into sequences of powers of two, which need no padding.

Tokens: a text is cut at single spaces between two characters that are surely not white
space; no token crosses such a cut, so a part's ids are found once and kept by the task process,
in flat arrays addressed by the part's hash.  New parts are encoded together in one call, as no
token crosses from one to the next; only the first and the last part of a text go alone.
A text that contains the special token's string is encoded whole by ``tokenizers``.

Defined results: a null text is empty; every document ends with the end id, so each has a
token; repeated rows and null ids are packed like others; an empty table gives no piece.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from emberscope.llm.kernels import Bytes, HashRows, bytes_of, slices
from emberscope.llm.tables import settled

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = b"<|endoftext|>"
LENGTH = 1024
END_ID = 0
DIMENSIONS, BITS = 4, 15
_REACH = 1.0  # coordinates beyond this are taken as this
_CACHED = 400_000  # parts in each of the two generations that a task process keeps

_SURE = np.zeros(256, bool)  # first bytes of characters that are not white space
_SURE[0x21:0x7F] = True
_SURE[0xC3:0xE0] = True


class _Parts:
    """Ids of parts seen before: rows of flat arrays, found by the parts' hashes."""

    def __init__(self, room: int):
        self.room, self.found = room, HashRows(room)
        self.at, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.found.add(hashes, np.arange(len(self.at), len(self.at) + len(hashes), dtype=np.int32))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])


class Encoder:
    """Texts to token ids, with the parts seen before kept."""

    def __init__(self, ranks: str, tokenizer: str):
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = max(table.values()) + 2
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.token_bytes = np.zeros(self.size, np.int64)
        self.token_bytes[list(table.values())] = [len(token) for token in table]
        self.tokenizer_path = tokenizer
        self.young, self.old = _Parts(_CACHED), _Parts(0)

    @lru_cache(maxsize=1)
    def whole(self) -> Tokenizer:
        return Tokenizer.from_file(self.tokenizer_path)

    def _new_parts(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these parts, one after the other, and how many each has."""
        joined = b"".join([raw[a:b] for a, b in zip(starts[~alone].tolist(), ends[~alone].tolist(), strict=True)])
        ids = np.array(self.fast.encode_ordinary(joined.decode()), np.int32)
        bounds = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum((ends - starts)[~alone])) + 1
        sizes = np.zeros(len(starts), np.int64)
        sizes[~alone] = np.diff(bounds, prepend=0)
        single = [self.fast.encode_ordinary(raw[a:b].decode()) for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)]
        sizes[alone] = [len(x) for x in single]
        out = np.zeros(int(sizes.sum()), np.int32)
        from_single = np.repeat(alone, sizes)
        out[~from_single], out[from_single] = ids, np.array([x for own in single for x in own], np.int32)
        return out, sizes

    def _rows(self, raw: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """The row of each part: of the young generation, or beyond it of the old one."""
        row = self.young.found.find(hashes)
        missing = np.flatnonzero(row < 0)
        before = self.old.found.find(hashes[missing])
        new = missing[before < 0]
        if len(new):
            key, first = np.unique(hashes[new], return_index=True)
            new = new[first]
            if len(self.young.at) + len(key) > self.young.room:  # the new generation takes all of this slice
                self.old, self.young = self.young, _Parts(max(_CACHED, len(np.unique(hashes))))
            self.young.add(key, *self._new_parts(raw, starts[new], ends[new], alone[new]))
            return self._rows(raw, hashes, starts, ends, alone)
        row[missing] = before + len(self.young.at)
        return row

    def encode(self, of: Bytes) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        data, offsets = of.data, of.offsets
        raw = data.tobytes()
        space = np.flatnonzero(data[1:-1] == 0x20) + 1 if len(data) > 2 else np.zeros(0, np.int64)
        before, after = data[space - 1], data[space + 1]
        plain = (before > 0x20) & (before < 0x7F)
        two = (before >= 0x80) & (before < 0xC0) & (data[space - 2] >= 0xC3) & (data[space - 2] < 0xE0)
        begins = np.zeros(len(data) + 1, bool)
        begins[space[(plain | two) & _SURE[after]]] = True
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(begins[:-1] | edge[:-1])
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        which = self._rows(raw, of.span_hashes(starts, ends), starts, ends, edge[starts] | edge[ends])
        counts = np.concatenate([self.young.sizes, self.old.sizes])[which]
        at = np.concatenate([self.young.at, len(self.young.ids) + self.old.at])[which]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = np.concatenate([self.young.ids, self.old.ids])[np.repeat(at - total[:-1], counts) + np.arange(total[-1])]
        bounds = total[np.searchsorted(starts, offsets)]
        if SPECIAL in raw:
            return self._with_special(raw, offsets, ids, bounds)
        return ids, np.diff(bounds)

    def _with_special(self, raw, offsets, ids, bounds):
        texts = []
        for i in range(len(offsets) - 1):
            text = raw[offsets[i] : offsets[i + 1]]
            own = ids[bounds[i] : bounds[i + 1]]
            if SPECIAL in text:
                own = np.array(self.whole().encode(text.decode(), add_special_tokens=False).ids, np.int32)
            texts.append(own)
        return np.concatenate(texts), np.fromiter(map(len, texts), np.int64, len(texts))


@lru_cache(maxsize=2)
def encoder(ranks: str, tokenizer: str) -> Encoder:
    return Encoder(ranks, tokenizer)


@lru_cache(maxsize=2)
def _directions(size: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((size, DIMENSIONS)).astype(np.float32)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of rows of unsigned coordinates below 2^bits."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):  # undo the turn of the cell that this level picks
            inverted = (x[i] & bit) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] & (1 << level)) != 0, turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ turn) >> level & 1)
    return key


def _keys(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Hilbert keys of documents from their token ids; every document has one at least."""
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
    means = np.add.reduceat(_directions(size)[ids], heads, axis=0) / counts[:, None]
    cells = (np.clip(means, -_REACH, _REACH) + _REACH) / (2 * _REACH) * ((1 << BITS) - 1)
    return hilbert_keys(cells.astype(np.int64))


def _tokenize(batches: Iterator[pa.RecordBatch], ranks: str, tokenizer: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(ranks, tokenizer)
    for batch in batches:
        for part in slices(batch, 1):
            ids, counts = encode.encode(bytes_of(part.column(1)))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, END_ID)
            counts = counts + 1
            keys = _keys(ids, counts, encode.size)
            narrow = ids.astype("<u2") if encode.size <= 1 << 16 else ids.astype("<u4")
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * narrow.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(narrow)])
            columns = [part.column(0), packed, pa.array(counts), pa.array(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n", "key"])


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(batches: Iterator[pa.RecordBatch], width: int, length: int) -> Iterator[pa.RecordBatch]:
    """Rows along the curve to pieces; only the open sequence is held."""
    names = ["doc_id", *[p.split()[0] for p in PIECES.split(", ")]]
    sequence = TaskContext.get().partitionId() << 33
    open_pieces: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the sequence being filled
    filled = 0
    schema = None

    def closed(pieces, number):
        at = 0
        for doc, start, ids, n in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, number, at
            at += len(ids)

    def rows_of(pieces):
        columns = [pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), [schema, *[pa.int64()] * 6], strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        schema = batch.schema.types[0]
        out = []
        for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.frombuffer(packed.as_buffer(), f"<u{width}")
            at = 0
            while at < len(ids):
                piece = ids[at : at + length - filled]
                open_pieces.append((doc, at, piece, len(ids)))
                at += len(piece)
                filled += len(piece)
                if filled == length:
                    out.extend(closed(open_pieces, sequence))
                    open_pieces, filled, sequence = [], 0, sequence + 1
        if out:
            yield rows_of(out)
        open_pieces = [(d, s, i.copy(), n) for d, s, i, n in open_pieces]
    out, size = [], 1 << max(filled.bit_length() - 1, 0)
    while open_pieces:  # the rest, in sequences of powers of two
        room, now, later = size, [], []
        for doc, start, ids, n in open_pieces:
            if room and len(ids):
                now.append((doc, start, ids[:room], n))
            if len(ids) > room:
                later.append((doc, start + room, ids[room:], n))
            room -= min(room, len(ids))
        out.extend(closed(now, sequence))
        open_pieces, filled, sequence = later, filled - size, sequence + 1
        size = 1 << max(filled.bit_length() - 1, 0)
    if out:
        yield rows_of(out)


def packed(docs: DataFrame, ranks: str = RANKS, tokenizer: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``length`` is a power of two.  Sequences of one task are numbered in one block.
    """
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_field = T.StructField("doc_id", narrow.schema[0].dataType)
    columns = [id_field, *T.StructType.fromDDL("ids binary, n long, key long")]
    tokens = settled(narrow.mapInArrow(partial(_tokenize, ranks=ranks, tokenizer=tokenizer), T.StructType(columns)), "tokens")
    width = 2 if encoder(ranks, tokenizer).size <= 1 << 16 else 4
    along = tokens.select("doc_id", "ids", "key").repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    schema = T.StructType([id_field, *T.StructType.fromDDL(PIECES)])
    return along.select("doc_id", "ids").mapInArrow(partial(_pack, width=width, length=length), schema)
