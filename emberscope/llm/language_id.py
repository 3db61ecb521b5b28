"""Language of a text, by labelled spans.

Counts of byte n-grams inside words, learned per label, give every word a score per language.
The scripts of a word's letters narrow the candidates: a language that hardly uses a script
in its training texts cannot own a word in it.  A Viterbi pass then finds the best labelling
of the words when every change of language costs ``SWITCH``; its runs are the spans, and the
language with the most letters names the text.

Learning is one pass that adds up counts per task and one small shuffle; the model (a table
of fixed width per label) is broadcast.  ``MOST_LABELS`` bounds it; more labels are an error.
Labelling holds words times labels for at most ``_HELD`` scores; a text of more words is
labelled stretch by stretch: the best value of each label is carried on, and what the way back
needs is one bit per word and label.

Defined results: a null text or one without a letter is ``und`` with score 0; with nothing
learned every text is ``und``; rows are judged one by one, so repeated rows and null ids are
like others (a null id is not learned from); ties go to the label that sorts first; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope.llm.kernels import Bytes, U, Words, bytes_of, per_text, slices
from emberscope.llm.tables import fold

FOLDS, HELD_OUT = 4, 2
MOST_LABELS = 200
SWITCH = 12.0
NONE = "und"
_GRAMS = (3, 4)
_WIDTH = 1 << 16  # buckets of each gram length
_SMOOTH = 0.5
_SCRIPT_SHARE = 0.01  # of a language's letters, for it to own words in that script
_BANNED = -1000.0
_HELD = 64 << 20  # bytes of text times labels that are labelled together
_LEAST = 1 << 16
_STRETCH = 1 << 20  # bytes of a long text at a time

#: First code points of blocks and the script that holds from there on.
SCRIPT_STARTS = (
    (0x00, "common"), (0x41, "latin"), (0x5B, "common"), (0x61, "latin"), (0x7B, "common"), (0xC0, "latin"),
    (0x2B0, "common"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x700, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "other"), (0xE00, "thai"), (0xE80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"),
    (0x2C00, "other"), (0x3000, "common"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF00, "common"), (0x20000, "han"),
)
_SCRIPTS = sorted({name for _, name in SCRIPT_STARTS} - {"common"})
_STARTS = np.array([at for at, _ in SCRIPT_STARTS])
_SCRIPT_OF = np.array([_SCRIPTS.index(name) if name != "common" else -1 for _, name in SCRIPT_STARTS])
_ASCII_SCRIPT = _SCRIPT_OF[np.searchsorted(_STARTS, np.arange(128), side="right") - 1]
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
BUCKETS = _WIDTH * len(_GRAMS) + len(_SCRIPTS)


def _script_ids(data: np.ndarray) -> np.ndarray:
    """At the first byte of each letter its script, elsewhere -1."""
    out = np.full(len(data), -1, np.int8)
    ascii_ = data < 0x80
    out[ascii_] = _ASCII_SCRIPT[data[ascii_]]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        wide = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
        b = wide[lead]
        tail = [wide[lead + k] & 0x3F for k in (1, 2, 3)]
        two = (b & 0x1F) << 6 | tail[0]
        three = (b & 0x0F) << 12 | tail[0] << 6 | tail[1]
        four = (b & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
        code = np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))
        out[lead] = _SCRIPT_OF[np.searchsorted(_STARTS, code, side="right") - 1]
    return out


class Grams:
    """Per byte of each word its n-gram buckets, and per word its letters and scripts."""

    def __init__(self, of: Bytes):
        of = of.lowered()
        self.words = words = Words(of)
        data = of.data
        at = np.flatnonzero(words.inside)
        sizes = words.end - words.start
        self.heads = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        place = np.arange(len(at)) - np.repeat(self.heads, sizes)
        code = data[at].astype(np.uint64)
        self.buckets = []
        for back in range(1, max(_GRAMS)):
            before = np.where(place >= back, data[at - back], 0x20).astype(np.uint64)
            code |= before << U(8 * back)
            if back + 1 in _GRAMS:
                mixed = (code * U(0x9E3779B97F4A7C15)) >> U(48)
                self.buckets.append(mixed.astype(np.int64) + _WIDTH * len(self.buckets))
        script = _script_ids(data)
        self.letters = per_text(script[at] >= 0, np.append(self.heads, len(at))) if len(sizes) else np.zeros(0, np.int64)
        self.script = script[at]

    def script_sets(self) -> np.ndarray:
        """Bits of the scripts in each word."""
        bits = np.where(self.script >= 0, 1 << np.maximum(self.script, 0).astype(np.int64), 0)
        return np.bitwise_or.reduceat(bits, self.heads) if len(self.heads) else np.zeros(0, np.int64)

    def counts(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.int64)
        lettered = np.repeat(self.letters > 0, self.words.end - self.words.start)
        for b in self.buckets:
            out += np.bincount(b[lettered], minlength=BUCKETS)
        out[_WIDTH * len(_GRAMS) :] += np.bincount(self.script[self.script >= 0], minlength=len(_SCRIPTS))
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, bucket, n), added up over the task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        codes = coded.indices.to_numpy()
        for i, lang in enumerate(coded.dictionary.to_pylist()):
            own = batch.take(pa.array(np.flatnonzero(codes == i)))
            sums = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for part in slices(own, 1, 1 << 20):
                sums += Grams(bytes_of(part.column(1))).counts()
    for lang, sums in total.items():
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(sums[used])], ["lang", "bucket", "n"])


class Model:
    """Labels in order, log probabilities per bucket and label, and owned scripts per label."""

    def __init__(self, labels: list[str], counts: Iterable[np.ndarray]):
        """``counts`` has one array per label."""
        self.labels = labels
        self.scores = np.zeros((_WIDTH * len(_GRAMS), len(labels)), np.float32)
        self.owned = np.zeros(len(labels), np.int64)
        for i, own in enumerate(counts):
            for k in range(len(_GRAMS)):
                part = own[k * _WIDTH : (k + 1) * _WIDTH].astype(np.float64)
                self.scores[k * _WIDTH : (k + 1) * _WIDTH, i] = np.log((part + _SMOOTH) / (part.sum() + _SMOOTH * _WIDTH))
            scripts = own[_WIDTH * len(_GRAMS) :]
            self.owned[i] = ((scripts >= _SCRIPT_SHARE * max(scripts.sum(), 1)).astype(np.int64) << np.arange(len(_SCRIPTS))).sum()

    def word_scores(self, grams: Grams) -> np.ndarray:
        """One row per word; words without a letter favour no language."""
        n, k = len(grams.words), len(self.labels)
        out = np.zeros((n, k), np.float32)
        if not n:
            return out
        for b in grams.buckets:
            out += np.add.reduceat(self.scores[b], grams.heads, axis=0)
        sets = grams.script_sets()
        allowed = (sets[:, None] & ~self.owned[None, :]) == 0
        allowed |= ~allowed.any(axis=1)[:, None]
        out[~allowed] += _BANNED
        out[grams.letters == 0] = 0
        return out


def learn(texts: DataFrame) -> Model:
    """A model of a table (lang, text)."""
    rows = texts.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(r["lang"] for r in texts.select("lang").distinct().limit(MOST_LABELS + 1).collect())
    if len(langs) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    packed = rows.groupBy("lang").agg(F.collect_list(F.struct(F.col("bucket").cast("int").alias("bucket"), "n")).alias("c"))  # at most BUCKETS each
    found = packed.select("lang", F.col("c.bucket").alias("bucket"), F.col("c.n").alias("n")).toArrow()
    place = {lang: i for i, lang in enumerate(found["lang"].to_pylist())}

    def counts_of(lang: str) -> np.ndarray:
        out = np.zeros(BUCKETS, np.int64)
        if lang in place:
            out[np.asarray(found["bucket"][place[lang]].values)] = np.asarray(found["n"][place[lang]].values)
        return out

    return Model(langs, map(counts_of, langs))


def _long_text(text: Bytes) -> Iterator[Bytes]:
    """A text in stretches that cut no word."""
    data, at = text.data, 0
    gaps = np.flatnonzero(~Words(text).inside)
    while at < len(data):
        to = len(data)
        if to - at > _STRETCH:
            i = np.searchsorted(gaps, at + _STRETCH)
            to = int(gaps[i]) + 1 if i < len(gaps) else to
        yield Bytes(data[at:to], np.array([0, to - at]))
        at = to


def labelled_stretches(stretches: Iterable[np.ndarray], k: int, switch: float = SWITCH) -> np.ndarray:
    """The best labels of the words of one text whose scores come in stretches."""
    value, bits, tops = None, [], []
    for scores in stretches:
        stays, top = np.ones((len(scores), k), bool), np.zeros(len(scores), np.int16)
        for t, own in enumerate(scores.astype(np.float64)):
            if value is None:
                value = own.copy()
                continue
            top[t] = value.argmax()
            change = value[top[t]] - switch
            stays[t] = value >= change
            value = np.where(stays[t], value, change) + own
        bits.append(np.packbits(stays, axis=1))
        tops.append(top)
    out, label = [], int(value.argmax()) if value is not None else 0
    for packed, top in zip(reversed(bits), reversed(tops), strict=True):
        stays = np.unpackbits(packed, axis=1, count=k).astype(bool)
        own = np.zeros(len(top), np.int16)
        for t in range(len(top) - 1, -1, -1):
            own[t] = label
            label = label if stays[t, label] else int(top[t])
        out.append(own)
    return np.concatenate([*reversed(out), np.zeros(0, np.int16)])


def labelling(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word, all texts of a batch side by side, word by word."""
    n, k = scores.shape
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = bounds[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with a word number t
    came = np.zeros((n, k), np.int16)
    own = np.arange(k, dtype=np.int16)
    best = np.zeros((len(order), k))
    for t in range(longest):
        now = active[t]
        rows = first[:now] + t
        value = best[:now]
        if t:
            top = value.argmax(axis=1)
            change = value[np.arange(now), top] - switch
            stays = value >= change[:, None]
            came[rows] = np.where(stays, own, top[:, None])
            value = np.where(stays, value, change[:, None])
        value = value + scores[rows]
        best[:now] = value
    out = np.zeros(n, np.int16)
    label = best.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        now = active[t]
        rows = first[:now] + t
        out[rows] = label[:now]
        label[:now] = came[rows, label[:now]]
    return out


def _label(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to doc_id, lang_pred, score and spans."""
    labels = model.value.labels
    together = max(_HELD // max(len(labels), 1), _LEAST)
    for batch in batches:
        for part in slices(batch, 1, together):
            scores, letters, counts, named = [], [], [], []
            long = bool(labels) and part.num_rows == 1 and len(bytes_of(part.column(1)).data) > together
            for small in slices(part, 1, 1 << 20):
                of = bytes_of(small.column(1))
                has = per_text(_ASCII_LETTER[of.data], of.offsets) > 0
                for i in np.flatnonzero(~has):  # few: texts without a-z
                    has[i] = any(map(str.isalpha, small.column(1)[int(i)].as_py()))
                named.append(has)
                if long:
                    continue
                grams = Grams(of)
                scores.append(model.value.word_scores(grams))
                letters.append(grams.letters)
                counts.append(grams.words.counts)
            if long:
                def stretches():
                    for some in _long_text(bytes_of(part.column(1))):
                        grams = Grams(some)
                        letters.append(grams.letters)
                        yield model.value.word_scores(grams)

                label = labelled_stretches(stretches(), len(labels))
                letters, named = np.concatenate([*letters, np.zeros(0, np.int64)]), named[0]
                counts = np.array([len(label)])
            else:
                scores, letters, counts, named = (np.concatenate(x) for x in (scores, letters, counts, named))
            bounds = np.concatenate([[0], np.cumsum(counts)])
            n = part.num_rows
            named &= bool(labels)
            if labels:
                label = label if long else labelling(scores, bounds)
                text = np.repeat(np.arange(n), counts)
                weight = np.bincount(text * len(labels) + label, np.maximum(letters, 0), n * len(labels)).reshape(n, -1)
                pred = weight.argmax(axis=1)
                share = weight.max(axis=1) / np.maximum(weight.sum(axis=1), 1)
                head = np.ones(len(label), bool)
                head[1:] = (label[1:] != label[:-1]) | (text[1:] != text[:-1])
                head &= named[text]
                at = np.flatnonzero(head)
                ends = np.minimum(np.append(at[1:], len(label)), bounds[text[at] + 1])
                span_counts = np.bincount(text[at], minlength=n)
                rows = [at - bounds[text[at]], ends - at]
                lang = pa.DictionaryArray.from_arrays(pa.array(label[at].astype(np.int32)), pa.array(labels)).cast(pa.string())
                names = np.array([*labels, NONE], object)[np.where(named, pred, len(labels))]
                share = np.where(named, share, 0.0)
            else:
                span_counts, rows, lang = np.zeros(n, np.int64), [np.zeros(0, np.int64)] * 2, pa.array([], pa.string())
                names, share = np.array([NONE] * n, object), np.zeros(n)
            offsets = np.concatenate([[0], np.cumsum(span_counts)]).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(rows[0]), pa.array(rows[1]), lang], ["first_word", "n_words", "lang"])
            columns = [part.column(0), pa.array(names.tolist(), pa.string()), pa.array(share), pa.ListArray.from_arrays(pa.array(offsets), spans)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"])


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score (its share of the letters) and the labelled spans."""
    narrow = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = "lang_pred string, score double, spans array<struct<first_word: long, n_words: long, lang: string>>"
    schema = T.StructType([T.StructField("doc_id", narrow.schema[0].dataType), *T.StructType.fromDDL(spans)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return narrow.mapInArrow(partial(_label, model=shared), schema)


def training(docs: DataFrame, rows: Column) -> DataFrame:
    """The labelled texts among those rows."""
    return docs.where(rows & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Predictions learned from the rows outside fold 2 of four; ``held_out`` marks that fold."""
    own = fold(F.col("doc_id"), FOLDS)
    model = learn(training(docs, F.coalesce(own != HELD_OUT, F.lit(False))))
    return languages(docs, model).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))
