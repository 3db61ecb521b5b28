"""Language-model scores: prediction by partial matching over bytes, and a unigram base score.

The model is a trie of byte contexts of up to four symbols, trained once on all training
documents and then frozen.  A symbol seen after the longest known context is coded with its
count; else an escape is coded and the next shorter context asked, without the symbols that
the longer one has already ruled out (symbol exclusion; the escape counts the distinct
symbols).  Below the empty context all symbols left are equally likely.  Texts are lower-cased
(A-Z) and end with an end symbol, which the model codes too.

Counts cover every training document, and no gram is left out.  One pass counts words and
five-symbol grams per batch, one shuffle adds them up; shorter contexts are sums of longer ones.
The trie stays a set of tables: totals of contexts, what a shorter context has left once a
longer one has ruled out its symbols, and the cost of every gram that occurs in training.
Tasks receive the costs of the most frequent grams (at most ``CACHED_GRAMS``) as a cache; the
other grams of a text are listed with their number of uses and joined with the tables, those
that training lacks through one join per order.  Words are met in the same way: the most
frequent ones (at most ``MOST_WORDS``) by a cache, all others by a join.  The caches change
no result.

Defined results: a null text is empty, and an empty text still has its end token; a null id
is scored, not held out and not learned from; repeated rows are scored each; an empty table
gives an empty result; with nothing to learn from, all symbols are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope.llm.kernels import Bytes, HashRows, U, Words, bytes_of, per_text, slices
from emberscope.llm.tables import fold, settled

ORDER = 4
CACHED_GRAMS = 500_000
MOST_WORDS = 200_000
FOLDS = 10
_EDGE = 256  # starts and ends a text
_SYMBOLS = 257
_BITS = 9
_SLICE = 1 << 20
_HELD = 1 << 20  # counts of grams held apart before they are merged


def _grams(of: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """The last five symbols at each byte and at each end, and the range of each text."""
    n = len(of)
    sizes = np.diff(of.offsets)
    at = np.arange(n) * (ORDER + 1)
    symbols = np.full(len(of.data) + n * (ORDER + 1) + 0, _EDGE, np.uint64)
    target = np.arange(len(of.data)) + np.repeat(at + ORDER, sizes)
    symbols[target] = of.data
    grams = symbols.copy()
    for back in range(1, ORDER + 1):
        grams[back:] |= symbols[:-back] << U(_BITS * back)
    coded = np.ones(len(symbols), bool)
    starts = of.offsets[:-1] + at
    for k in range(ORDER):
        coded[starts + k] = False
    bounds = of.offsets + np.arange(n + 1)
    return grams[coded], bounds


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a row that has each, and its total count."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[heads], order[heads], np.add.reduceat(count[order], heads) if len(heads) else count


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Those byte spans as strings."""
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    inner = np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[-1])
    buffers = [pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[inner])]
    return pa.StringArray.from_buffers(len(sizes), *buffers)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word, gram, n): the counts of a batch, and its texts as the empty word."""
    for batch in batches:
        grams, gram_counts, words, word_counts, data, start, end = [], [], [], [], [], [], []
        base = 0
        for part in slices(batch, 0, _SLICE):
            of = bytes_of(part.column(0)).lowered()
            key, n = np.unique(_grams(of)[0], return_counts=True)
            grams.append(key)
            gram_counts.append(n)
            if sum(map(len, grams)) > _HELD:
                key, _, n = _merged(grams, gram_counts)
                grams, gram_counts = [key], [n]
            found = Words(of)
            key, first, n = np.unique(found.hashes(), return_index=True, return_counts=True)
            words.append(key)
            word_counts.append(n)
            data.append(of.data)
            start.append(found.start[first] + base)
            end.append(found.end[first] + base)
            base += len(of.data)
        if not grams:
            continue
        key, _, n = _merged(grams, gram_counts)
        _, row, word_n = _merged(words, word_counts)
        text = _spans(np.concatenate(data), np.concatenate(start)[row], np.concatenate(end)[row])
        for a in range(0, len(key), 1 << 18):
            columns = [pa.nulls(len(key[a : a + (1 << 18)]), pa.string()), pa.array(key[a : a + (1 << 18)].view(np.int64)), pa.array(n[a : a + (1 << 18)])]
            yield pa.RecordBatch.from_arrays(columns, ["word", "gram", "n"])
        yield pa.RecordBatch.from_arrays([text, pa.nulls(len(text), pa.int64()), pa.array(word_n)], ["word", "gram", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.nulls(1, pa.int64()), pa.array([batch.num_rows])], ["word", "gram", "n"])


def counts(texts: DataFrame) -> DataFrame:
    """(word, gram, n) over a table of one column of texts; one of word and gram is null."""
    rows = texts.mapInArrow(_count, "word string, gram long, n long")
    return settled(rows.groupBy("word", "gram").agg(F.sum("n").alias("n")), "language-counts")


def _level() -> Column:
    """Counts in steps of an eighth of a power of two: few values whatever the corpus."""
    return F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")


def _most_frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the highest levels of counts, at most ``most`` of them."""
    left, least = 0, 1 << 10
    for level, k in sorted(map(tuple, rows.groupBy(_level()).count().collect()), reverse=True):
        left += k
        if left > most:
            break
        least = level
    return rows.where(_level() >= least)


# ---------------------------------------------------------------------------
# The trie as tables
# ---------------------------------------------------------------------------
def _last(k: int) -> Column:
    """The last k + 1 symbols of a gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << _BITS * (k + 1)) - 1))


def _context(k: int) -> Column:
    """The k symbols before a gram's last one."""
    return F.shiftright(_last(k), _BITS)


def _bounded(df: DataFrame, symbols: int) -> DataFrame:
    """Tables of up to two symbols have at most 257^2 rows and are broadcast."""
    return F.broadcast(df) if symbols <= 2 else df


def orders(grams: DataFrame) -> list[DataFrame]:
    """(gram, n) of each context length from 0 to 4, from a table of five-symbol grams."""
    out = [grams]
    for k in range(ORDER - 1, -1, -1):
        out.append(settled(out[-1].groupBy(_last(k).alias("gram")).agg(F.sum("n").alias("n")), f"grams-{k}"))
    return out[::-1]


def known_costs(grams: DataFrame) -> DataFrame:
    """(gram, n, cost): log10 of the probability of every gram of the longest order that was seen."""
    same = Window.partitionBy(_context(ORDER))  # at most 257 rows
    whole = F.sum("n").over(same) + F.count(F.lit(1)).over(same)
    return grams.select("gram", "n", F.log10(F.col("n") / whole).alias("cost"))


def contexts(by_order: list[DataFrame], k: int) -> DataFrame:
    """Per context of k symbols: total, kinds, and what the shorter context has besides its symbols."""
    own = by_order[k].withColumn("context", _context(k))
    if not k:
        return own.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    shorter = by_order[k - 1].select(F.col("gram").alias("_gram"), F.col("n").alias("_n"))
    rows = own.join(_bounded(shorter, k), _last(k - 1) == F.col("_gram")).groupBy("context").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("_n").alias("_taken")
    )
    parents = by_order[k - 1].groupBy(_context(k - 1).alias("_parent")).agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_kinds"))
    parent = F.col("context").bitwiseAND(F.lit((1 << _BITS * (k - 1)) - 1))
    return rows.join(_bounded(parents, k - 1), parent == F.col("_parent")).select(
        "context", "total", "kinds", (F.col("_total") - F.col("_taken")).alias("rest_total"), (F.col("_kinds") - F.col("kinds")).alias("rest_kinds")
    )


def escaped_costs(unseen: DataFrame, by_order: list[DataFrame]) -> DataFrame:
    """(gram, cost) of five-symbol grams that training lacks: one step per context length.

    Where the longer context is known (``ruled``), a shorter one counts only the symbols that
    the longer one lacks.
    """
    zero = F.lit(0).cast("long")
    left = unseen.select("gram", F.lit(0.0).alias("cost"), F.lit(False).alias("ruled"), zero.alias("rt"), zero.alias("rk"), F.lit(False).alias("done"))
    for k in range(ORDER, -1, -1):
        own = by_order[k].select(F.col("gram").alias("_gram"), F.col("n").alias("_n"))
        about = contexts(by_order, k)
        if k:
            about = about.select(F.col("context").alias("_context"), "total", "kinds", "rest_total", "rest_kinds")
        else:
            about = about.select(F.col("context").alias("_context"), "total", "kinds", zero.alias("rest_total"), zero.alias("rest_kinds"))
        rows = left.join(_bounded(own, k + 1), _last(k) == F.col("_gram"), "left")
        rows = rows.join(_bounded(about, k), _context(k) == F.col("_context"), "left")
        total, kinds = F.when(F.col("ruled"), F.col("rt")).otherwise(F.col("total")), F.when(F.col("ruled"), F.col("rk")).otherwise(F.col("kinds"))
        found, known = F.col("_n").isNotNull(), F.col("total").isNotNull()
        step = F.when(found, F.log10(F.col("_n") / (total + kinds))).when(known & (kinds > 0), F.log10(kinds / (total + kinds))).otherwise(0.0)
        left = rows.select(
            "gram", F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") + step).alias("cost"), known.alias("ruled"),
            F.coalesce("rest_total", zero).alias("rt"), F.coalesce("rest_kinds", zero).alias("rk"), (F.col("done") | found).alias("done"),
        )
    symbols = by_order[0].count()  # at most 257
    return left.select("gram", F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") - F.log10(F.lit(float(max(_SYMBOLS - symbols, 1))))).alias("cost"))


class Cache:
    """Costs of frequent grams, for whole arrays of grams."""

    def __init__(self, grams: np.ndarray, costs: np.ndarray):
        self.rows, self.costs = HashRows(len(grams)), np.append(costs, 0.0)
        self.rows.add(grams, np.arange(len(grams), dtype=np.int32))

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cost of each gram (0 if it is not here), and the numbers of those not here."""
        row = self.rows.find(grams)
        return self.costs[row], np.flatnonzero(row < 0)


def _rows(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


# ---------------------------------------------------------------------------
# Scores
# ---------------------------------------------------------------------------
def _listed(owner: np.ndarray, key: np.ndarray, n: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each of ``n`` owners: list offsets, keys, numbers of uses."""
    pair, uses = np.unique(owner.astype(np.int64) * max(kinds, 1) + key, return_counts=True)
    return np.searchsorted(pair // max(kinds, 1), np.arange(n + 1)).astype(np.int32), pair % max(kinds, 1), uses


def _score(batches: Iterator[pa.RecordBatch], cached: Broadcast, frequent: Broadcast) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to scores, and the words and grams to be looked up with their number of uses.

    ``frequent``: sorted word hashes and their log10 base probabilities.
    """
    task = TaskContext.get().partitionId() << 33
    done = 0
    hashes, costs = frequent.value
    for batch in batches:
        for part in slices(batch, 1, _SLICE):
            of = bytes_of(part.column(1)).lowered()
            n = len(of)
            grams, bounds = _grams(of)
            known_cost, missed = cached.value.find(grams)
            score = per_text(known_cost, bounds)
            gram, which = np.unique(grams[missed], return_inverse=True)
            gram_at, gram_no, gram_uses = _listed(np.searchsorted(bounds, missed, side="right") - 1, which, n, len(gram))
            words = Words(of)
            key, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
            row = _rows(hashes, key)
            known = (row >= 0)[which]
            cost = np.where(row >= 0, costs[row] if len(costs) else 0.0, 0.0)[which]
            base = per_text(cost, words.bounds)
            rare = np.flatnonzero(~known)
            listed, word, uses = _listed(words.text_of[rare], which[rare], n, len(key))
            text = _spans(of.data, words.start[first[word]], words.end[first[word]])
            columns = [
                pa.array(task + done + np.arange(n)), part.column(0), pa.array(words.counts + 1), pa.array(per_text(known, words.bounds)),
                pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(listed), text), pa.ListArray.from_arrays(pa.array(listed), pa.array(uses)),
                pa.ListArray.from_arrays(pa.array(gram_at), pa.array(gram[gram_no].view(np.int64))), pa.ListArray.from_arrays(pa.array(gram_at), pa.array(gram_uses)),
            ]
            done += n
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SCORED.split(", ")])


_SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, score double, words array<string>, uses array<long>, grams array<long>, gram_uses array<long>"


def scores(docs: DataFrame, training: Column) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` says which rows to learn from.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), training.alias("_learn"))
    counted = counts(texts.where("_learn").select("text"))
    words = counted.where("word IS NOT NULL").select("word", "n")
    n_all, n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    scale = float(n_all + 0.1 * (n_words + 1))
    base = lambda n: F.log10((n + F.lit(0.1)) / F.lit(scale))
    grams = counted.where("gram IS NOT NULL").select("gram", "n")
    costs = settled(known_costs(grams), "gram-costs")
    top = _most_frequent(costs, CACHED_GRAMS).select("gram", "cost").toArrow()
    cached = sc.broadcast(Cache(top["gram"].to_numpy().view(np.uint64), top["cost"].to_numpy()))
    inner = words.where("word <> ''")
    top = _most_frequent(inner, MOST_WORDS).toArrow()
    key = bytes_of(top["word"])
    order = np.argsort(hashed := key.span_hashes(key.offsets[:-1], key.offsets[1:]))
    frequent = sc.broadcast((hashed[order], np.log10((top["n"].to_numpy()[order] + 0.1) / scale)))

    scored = settled(texts.select("doc_id", "text").mapInArrow(partial(_score, cached=cached, frequent=frequent), _SCORED), "language-scores")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "uses")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.uses").alias("uses"))
    looked_up = rare.join(inner, "word", "left").groupBy("row").agg(
        F.sum(F.col("uses") * base(F.coalesce("n", F.lit(0)))).alias("rare_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("uses"))).alias("rare_known"),
    )
    missed = scored.select("row", F.explode(F.arrays_zip("grams", "gram_uses")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.gram_uses").alias("uses"))
    wanted = settled(missed.select("gram").distinct().join(costs.select("gram", "cost"), "gram", "left"), "wanted-grams")
    unseen = escaped_costs(wanted.where("cost IS NULL"), orders(grams))
    rare_scores = missed.join(wanted.where("cost IS NOT NULL").union(unseen), "gram").groupBy("row").agg(F.sum(F.col("uses") * F.col("cost")).alias("rare_score"))
    end_count = words.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    end_base, end_known = base(F.lit(end_count)), F.lit(int(end_count > 0))
    narrow = scored.drop("words", "uses", "grams", "gram_uses")
    return narrow.join(looked_up, "row", "left").join(rare_scores, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + end_known).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end_base).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores learned from the rows whose fold of ten is not 0; ``held_out`` marks the others."""
    own = fold(F.col("doc_id"), FOLDS)
    out = scores(docs, F.coalesce(own != 0, F.lit(False)))
    return out.withColumn("held_out", F.coalesce(own == 0, F.lit(False)))
