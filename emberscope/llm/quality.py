"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per document.  ``stored_ledger`` writes the measurements and one
bigint of failure bits; a policy is a named set of rules, so trying another one is a bit
test on the stored ledger, and ``ablations`` answers "what would each rule remove, and what
does it remove alone" from one count per distinct bit pattern.

Defined results: a null text has no words; rows are judged one by one, so repeated rows and
null ids pass through; an empty table gives an empty ledger; other columns are not read.
Equality of lines and of 5-word windows inside one document is decided by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope.llm.kernels import Words, bytes_of, per_text, scrambled, slices, window_hashes
from emberscope.llm.tables import settled

REPEAT_WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_stutters long"

#: Rule name to its failure condition over the measurements; the position is its bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "stutter": "10 * n_stutters > 3 * n_words",
}

#: Policies by version; a document is kept if no rule of the policy failed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": ("few_words", "repeated_words", "symbols", "short_words", "long_words", "stutter"),
    "strict": tuple(RULES),
}
PRODUCTION = "v2"

_MEASURED = "_measured"


def _mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _twins(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur twice or more, and which of those are not the first."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    again = np.zeros(len(keys), bool)
    again[1:] = ranked[1:] == ranked[:-1]
    twice = again.copy()
    twice[:-1] |= again[1:]
    out = np.zeros((2, len(keys)), bool)
    out[0, order], out[1, order] = twice, again
    return out[0], out[1]


def _measured(texts: pa.Array) -> list[np.ndarray]:
    of = bytes_of(texts)
    words = Words(of)
    data, offsets = of.data, of.offsets
    n_texts = len(of)
    chars = per_text(words.inside & ((data & 0xC0) != 0x80), offsets)
    symbols = per_text(_SYMBOL[data], offsets)

    starts = words.window_starts(REPEAT_WINDOW)
    text_of, hashes = words.text_of, words.hashes()
    same = np.zeros(len(words), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
    stutters = per_text(same, words.bounds)
    salt = scrambled(np.arange(n_texts, dtype=np.uint64))
    windows = window_hashes(hashes, REPEAT_WINDOW)[starts] ^ salt[text_of[starts]]
    twice, _ = _twins(windows)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts[twice], 1)
    np.subtract.at(edges, starts[twice] + REPEAT_WINDOW, 1)
    repeated = per_text(np.cumsum(edges[:-1]) > 0, words.bounds)

    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    filled = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    line_start, line_end = line_start[filled], line_end[filled]
    line_text = np.searchsorted(offsets, line_start, side="right") - 1
    _, again = _twins(of.span_hashes(line_start, line_end) ^ salt[line_text])
    n_lines = np.bincount(line_text, minlength=n_texts)
    dup_lines = np.bincount(line_text[again], minlength=n_texts)
    return [words.counts, chars, symbols, n_lines, dup_lines, repeated, stutters]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column is the text; it is replaced by the struct of measurements."""
    names = [m.split()[0] for m in MEASURES.split(", ")]
    for batch in batches:
        for part in slices(batch, batch.num_columns - 1, 1 << 20):
            *carried, texts = part.columns
            columns = [pa.array(np.asarray(c, np.int64)) for c in _measured(texts)]
            rows = pa.StructArray.from_arrays(columns, names)
            yield pa.RecordBatch.from_arrays([*carried, rows], [*part.schema.names[:-1], _MEASURED])


def measure(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns and a struct of measurements, in one pass and without a shuffle."""
    narrow = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").cast("string").alias(_MEASURED))
    schema = T.StructType([*narrow.schema[:-1], T.StructField(_MEASURED, T.StructType.fromDDL(MEASURES))])
    return narrow.mapInArrow(_measure, schema)


def _failures(prefix: str = "") -> Column:
    """The bits of the failed rules."""
    bits = F.lit(0).cast("long")
    for i, fails in enumerate(RULES.values()):
        condition = F.expr(re.sub(r"[a-z_]+", lambda name: prefix + name[0], fails))
        bits = bits.bitwiseOR(F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failures``, the bits of the failed rules."""
    failures = _failures()
    return measure(docs, ["doc_id"]).select("doc_id", f"{_MEASURED}.*").withColumn("failures", failures)


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger written once: policies and ablations are bit tests on it."""
    return settled(ledger(docs), "quality-ledger")


def with_policy(entries: DataFrame, version: str = PRODUCTION, name: str = "kept") -> DataFrame:
    """Whether no rule of the policy failed."""
    return entries.withColumn(name, F.col("failures").bitwiseAND(F.lit(_mask(POLICIES[version]))) == 0)


def ablations(entries: DataFrame) -> DataFrame:
    """Per policy and rule: documents the rule fails, fails alone, and kept without it."""
    patterns = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[
        F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(_mask((r,))).cast("long").alias("bit"), F.lit(_mask(rules)).cast("long").alias("mask"))
        for v, rules in POLICIES.items() for r in rules
    ])
    rows = patterns.select("failures", "n", F.explode(cases).alias("c")).select("failures", "n", "c.*")
    failed = F.col("failures").bitwiseAND(F.col("mask"))
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy("policy", "rule").agg(
        count(failed.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(failed == F.col("bit")).alias("n_failed_alone"),
        count((failed == 0) | (failed == F.col("bit"))).alias("n_kept_without"),
    )


def judged(docs: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` (never true for a base failure)."""
    entries = with_policy(with_policy(stored_ledger(docs), version, "kept"), "base", "base_kept")
    return entries.withColumn("base_failed", ~F.col("base_kept")).withColumn("kept", F.col("kept") & F.col("base_kept")).drop("base_kept")


def passing(docs: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """The documents the policy keeps, with all their columns, by their failure bits in one pass.

    The bits are not stored here: a ledger that can be filtered without another shuffle or
    evaluation would hold a copy of all texts.
    """
    mask = _mask(POLICIES["base"]) | _mask(POLICIES[version])
    kept = _failures(f"{_MEASURED}.").bitwiseAND(F.lit(mask)) == 0
    return measure(docs, docs.columns).where(kept).drop(_MEASURED)
