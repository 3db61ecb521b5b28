import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llmdata import awkward, prose, rows, spark_docs
from pyspark.sql import functions as F

from emberscope.llm import lm_scoring


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", lowered(text)), None]


def symbols(text):
    return [*lowered(text).encode(), 256]


class Trie:
    """Prediction by partial matching, symbol by symbol."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for text in texts:
            history = [256] * 4
            for s in symbols(text):
                for k in range(5):
                    self.seen[k, tuple(history[4 - k :])][s] += 1
                history = history[1:] + [s]

    def log10(self, text):
        total, history = 0.0, [256] * 4
        for s in symbols(text):
            ruled = set()
            for k in range(4, -1, -1):
                followers = {a: n for a, n in self.seen.get((k, tuple(history[4 - k :])), {}).items() if a not in ruled}
                if not followers:
                    continue
                whole = sum(followers.values()) + len(followers)
                if s in followers:
                    total += math.log10(followers[s] / whole)
                    break
                total += math.log10(len(followers) / whole)
                ruled |= set(followers)
            else:
                total -= math.log10(257 - len(ruled))
            history = history[1:] + [s]
        return total


def brute(data, learn):
    train = [t for i, t in data if learn(i)]
    count = Counter(w for t in train for w in tokens(t))
    trie, n, v = Trie(train), sum(count.values()), len(count)
    for i, t in data:
        words = tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        yield i, len(words), sum(count[w] > 0 for w in words), n, base, trie.log10(t)


@pytest.fixture(params=[(10**6, 10**5), (20, 20), (0, 0)])
def bounds(request, monkeypatch):
    """The caches change no result."""
    monkeypatch.setattr(lm_scoring, "CACHED_GRAMS", request.param[0])
    monkeypatch.setattr(lm_scoring, "MOST_WORDS", request.param[1])


def check(got, data, learn):
    got = {r["doc_id"]: r for r in got.collect()}
    assert len(got) == len(data)
    for i, n_tokens, n_known, n, base, score in brute(data, learn):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learn(i), n_tokens, n_known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def learned(i):
    return zlib.crc32(str(i).encode()) % 10 != 0


def test_scores_match_brute_force(spark, bounds):
    data = [(i, t if len(t or "") < 3000 else t[:3000]) for i, t in enumerate([*awkward(), "naïve \x00 Ünseen 日本", "QQQ zzz"])]
    check(lm_scoring.held_out_scores(spark_docs(spark, rows([t for _, t in data])).repartition(3)), data, learned)


def test_rare_grams_count_where_every_byte_is_frequent(spark, bounds):
    rng = random.Random(6)
    data = [(i, prose(rng, 30) + " " + "".join(rng.choice("abcdefgh ") for _ in range(300))) for i in range(60)]
    train = Counter(b for i, t in data if learned(i) for b in t.encode())
    assert min(train.values()) >= 10
    check(lm_scoring.held_out_scores(spark_docs(spark, rows([t for _, t in data]))), data, learned)


def test_scores_of_a_given_table_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    short = docs.where("length(text) < 1500")
    check(lm_scoring.held_out_scores(short), sorted(map(tuple, short.collect())), learned)


def test_probabilities_of_a_context_add_up(spark):
    texts = spark.createDataFrame([("the cat sat",), ("the car ran on",), ("at a rate",)], "text string")
    grams = lm_scoring.counts(texts).where("gram is not null").select("gram", "n")
    by_order, known = lm_scoring.orders(grams), lm_scoring.known_costs(grams)
    histories = ([256] * 4, list(b"the "), list(b"xcat"), list(b"zzzz"), list(b" cat"))
    wanted = [(j, sum(s << 9 * (4 - i) for i, s in enumerate(h)) | s) for j, h in enumerate(histories) for s in range(257)]
    asked = spark.createDataFrame(wanted, "history int, gram long")
    unseen = lm_scoring.escaped_costs(asked.select("gram").distinct().join(known, "gram", "left_anti"), by_order)
    found = asked.join(known.select("gram", "cost").union(unseen), "gram").groupBy("history").agg(F.count("*").alias("n"), F.sum(F.pow(F.lit(10.0), "cost")).alias("p"))
    assert [(r["n"], round(r["p"], 9)) for r in found.collect()] == [(257, 1.0)] * len(histories)


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark_docs(spark, [*rows(["ab", None]), (None, "c", None, None, None, None, None), *rows(["ab"])])
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_known"], round(r["score"], 4)) for r in lm_scoring.scores(docs, F.lit(False)).collect())
    bit = -math.log10(257)
    assert got == [(-1, 0, round(2 * bit, 4)), (0, 0, round(3 * bit, 4)), (0, 0, round(3 * bit, 4)), (1, 0, round(bit, 4))]
    assert lm_scoring.held_out_scores(spark_docs(spark, [])).count() == 0
