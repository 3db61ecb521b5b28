"""Toxicity by multiple-instance learning.

Only documents carry labels.  Every sentence gets a score from its words, and a document is
toxic unless each of its sentences is not: the document's probability is the noisy-or of its
sentences' probabilities.  The weights are learned through that noisy-or from document labels,
so the sentence scores locate what made a document toxic.

Features of a word are itself and its proper prefixes of 4 to 8 bytes, hashed.  The weights
are fitted on a bounded sample: of each class the first ``MOST_OF_A_CLASS`` labelled documents
by a hash of the id, as far as they fit into ``MOST_BYTES`` of text together (the bound on
what the driver fits), whatever their length.  Scoring covers every whole text.

Defined results: an empty or null text gets the noisy-or of no sentence, which is 0; null
labels and labels of unknown documents teach nothing; a text longer than ``MOST_BYTES`` is
scored but teaches nothing; several labels of one id count as toxic if one is; with no example of a class all scores are 0; repeated rows and null ids are
scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope.llm.kernels import Bytes, U, Words, bytes_of, per_text, scrambled, slices
from emberscope.llm.tables import fold

FOLDS, HELD_OUT = 3, 1
TOXIC_FROM = 0.7
MOST_OF_A_CLASS = 4000
MOST_BYTES = 8 << 20
_WIDTH = 1 << 20
_PREFIXES = (4, 5, 6, 7, 8)
_ROUNDS = 300
_STEP = 0.1
_START = -7.0  # a sentence is hardly ever toxic before anything is learned
_SHRINK = 0.5  # documents that must speak for a feature before it gets a weight
_RARE = 3  # sentences of the sample that a feature must occur in

_PAUSE = np.zeros(256, bool)
_PAUSE[[0x21, 0x2E, 0x3F, 0x0A]] = True  # ! . ? and line feed
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Sentences:
    """The features of the sentences of some texts.

    ``features`` are buckets, distinct inside a sentence; ``heads`` is where each sentence's
    begin; ``first_word`` and ``n_words`` place it; ``bounds`` are the sentences of each text.
    """

    def __init__(self, of: Bytes):
        of = of.lowered()
        words = Words(of, _LETTER[of.data])
        ends = np.flatnonzero(_PAUSE[of.data])
        place = np.searchsorted(ends, words.start)  # of all pauses so far
        text = words.text_of
        new = np.ones(len(words), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        self.first_word = np.flatnonzero(new)
        self.n_words = np.diff(np.append(self.first_word, len(words)))
        sentence_of = np.repeat(np.arange(len(self.first_word)), self.n_words)
        owner = text[self.first_word]
        self.bounds = np.searchsorted(owner, np.arange(len(of) + 1))
        self.byte_start = words.start[self.first_word] - of.offsets[owner]
        self.byte_end = (words.end[self.first_word + self.n_words - 1] if len(owner) else words.end[:0]) - of.offsets[owner]

        sums = of.running_hash()
        keys, owners = [of.hash_between(sums, words.start, words.end)], [sentence_of]
        for k in _PREFIXES:
            longer = words.end - words.start > k
            keys.append(scrambled(of.hash_between(sums, words.start[longer], words.start[longer] + k) + U(k)))
            owners.append(sentence_of[longer])
        bucket = (np.concatenate(keys) >> U(44)).astype(np.int64)
        pairs = np.unique(np.concatenate(owners) * _WIDTH + bucket)
        self.features = pairs % _WIDTH
        self.heads = np.searchsorted(pairs, np.arange(len(self.first_word)) * _WIDTH)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, features, sizes): the features of all sentences and how many each has."""
    for batch in batches:
        for part in slices(batch, 1, 1 << 20):
            s = Sentences(bytes_of(part.column(1)))
            sizes = np.diff(np.append(s.heads, len(s.features)))
            inner = np.append(s.heads, len(s.features))[s.bounds]
            columns = [
                part.column(0), pa.ListArray.from_arrays(pa.array(inner.astype(np.int32)), pa.array(s.features.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(s.bounds.astype(np.int32)), pa.array(sizes.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["label", "features", "sizes"])


class Model:
    """Sparse weights of features, and the score of a sentence without any."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def dense(self) -> np.ndarray:
        out = np.zeros(_WIDTH, np.float32)
        out[self.features] = self.weights
        return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fitted(labels: np.ndarray, features: np.ndarray, sizes: np.ndarray, sentence_counts: np.ndarray) -> Model:
    """Weights that make the noisy-or of the sentences fit the labels of the documents.

    The rows of ``features`` (per document, sentence by sentence) and ``sizes`` are flat.
    """
    owner = np.repeat(np.arange(len(labels)), sentence_counts)
    used = np.flatnonzero(np.bincount(features, minlength=1) >= _RARE)
    if not len(used) or labels.min(initial=1) == labels.max(initial=0) or not len(labels):
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    column = np.minimum(np.searchsorted(used, features), len(used) - 1)
    known = used[column] == features
    column = column[known]
    sentence = np.repeat(np.arange(len(sizes)), sizes)[known]
    del known

    weights, bias = np.zeros(len(used)), _START
    squares = np.zeros(len(used) + 1)
    weight_of = 1.0 / len(labels)
    for step in range(1, _ROUNDS + 1):
        z = bias + np.bincount(sentence, weights[column], len(sizes))
        total = np.bincount(owner, _softplus(z), len(labels))
        pull = np.where(labels == 1, -1.0 / np.expm1(np.maximum(total, 1e-9)), 1.0)
        dz = pull[owner] / (1.0 + np.exp(-z)) * weight_of
        gradient = np.append(np.bincount(column, dz[sentence], len(used)), dz.sum())
        squares = 0.95 * squares + 0.05 * gradient**2
        scale = _STEP / (np.sqrt(squares / (1 - 0.95**step)) + weight_of)
        weights -= scale[:-1] * gradient[:-1]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - scale[:-1] * _SHRINK * weight_of, 0.0)
        bias = min(bias - scale[-1] * gradient[-1], _START)  # long clean documents must stay clean
    return Model(used, weights, float(bias))


def learn(docs: DataFrame, labels: DataFrame, rows: Column) -> Model:
    """A model from the labels (doc_id, toxic) that ``rows`` picks, on a bounded sample."""
    named = labels.where(rows & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    named = named.groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    sizes = texts.groupBy("_id").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))
    there = named.join(sizes, F.col("_labelled") == F.col("_id")).select("label", "_labelled", "size")
    picked = []
    for k in (1, 0):
        room = MOST_BYTES
        for row in there.where(F.col("label") == k).orderBy(F.xxhash64("_labelled"), "_labelled").limit(MOST_OF_A_CLASS).collect():
            if row["size"] <= room:
                room -= row["size"]
                picked.append((row["label"], row["_labelled"]))
    sample = docs.sparkSession.createDataFrame(picked, "label int, _labelled long")  # its size is bounded
    chosen = texts.join(F.broadcast(sample), F.col("_id") == F.col("_labelled")).select("label", "text")
    table = chosen.mapInArrow(_features, "label int, features array<int>, sizes array<int>").toArrow().combine_chunks()
    flat = [table[c].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("features", "sizes")]
    features, sizes = (np.asarray(f.flatten()) for f in flat)
    return fitted(table["label"].to_numpy(), features, sizes, np.asarray(flat[1].value_lengths()))


def _score(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to doc_id, score and the offending sentences."""
    weights, bias = model.value.dense(), model.value.bias
    for batch in batches:
        for part in slices(batch, 1, 1 << 20):
            s = Sentences(bytes_of(part.column(1)))
            sums = np.concatenate([[0.0], np.cumsum(weights[s.features], dtype=np.float64)])
            z = bias + sums[np.append(s.heads[1:], len(s.features))[: len(s.heads)]] - sums[s.heads]
            score = -np.expm1(-per_text(_softplus(z), s.bounds))
            own = 1.0 / (1.0 + np.exp(-z))
            bad = np.flatnonzero(own >= 0.5)
            offsets = np.searchsorted(bad, s.bounds).astype(np.int32)
            found = pa.StructArray.from_arrays(
                [pa.array(s.byte_start[bad]), pa.array(s.byte_end[bad]), pa.array(own[bad])], ["byte_start", "byte_end", "score"]
            )
            columns = [part.column(0), pa.array(np.clip(score, 0.0, 1.0)), pa.ListArray.from_arrays(pa.array(offsets), found)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "sentences"])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score, predicted, and the byte spans of sentences of 0.5 and more."""
    narrow = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fields = "score double, sentences array<struct<byte_start: long, byte_end: long, score: double>>"
    schema = T.StructType([T.StructField("doc_id", narrow.schema[0].dataType), *T.StructType.fromDDL(fields)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = narrow.mapInArrow(partial(_score, model=shared), schema)
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def held_out_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores learned from the labels outside fold 1 of three; ``held_out`` marks that fold."""
    model = learn(docs, labels, F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(False)))
    return toxicity(docs, model).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))
