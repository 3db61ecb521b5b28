import math
import random
import re

import numpy as np
from llmdata import awkward, prose, rows, spark_docs
from pyspark.sql import functions as F

from emberscope.llm import toxicity as X

LABELS = "doc_id long, toxic int, quality int, text string"


def data(n=300, seed=6):
    """Documents of five sentences; toxic ones hold a bad word in one."""
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        sentences = [prose(rng, 8, 300) for _ in range(5)]
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            sentences[rng.randrange(5)] += f" {rng.choice(['Scumbag', 'VILEST', 'ünwort'])}, x"
        texts.append(". ".join(sentences) + ".")
    return texts, toxic


def labels_of(spark, toxic):
    return spark.createDataFrame([(i, t, 0, "clash") for i, t in enumerate(toxic)], LABELS)


def test_held_out_documents_and_their_sentences(spark):
    texts, toxic = data()
    got = X.held_out_toxicity(spark_docs(spark, rows(texts)), labels_of(spark, toxic)).collect()
    assert len(got) == len(texts) and 50 < sum(r["held_out"] for r in got) < 150
    wrong = [r["doc_id"] for r in got if r["predicted"] != toxic[r["doc_id"]] and r["held_out"]]
    assert len(wrong) <= 2
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        for s in r["sentences"]:
            part = texts[r["doc_id"]].encode()[s["byte_start"] : s["byte_end"]].decode()
            assert re.search("scumbag|vilest|ünwort", part.lower())


def test_score_is_the_noisy_or_of_the_sentences(spark):
    weights = {"bad": 6.0, "worse": 9.0}
    from emberscope.llm.kernels import bytes_of
    import pyarrow as pa

    bucket = {w: int(X.Sentences(bytes_of(pa.array([w]))).features[0]) for w in ("bad",)}
    model = X.Model(np.array(list(bucket.values())), np.array([weights["bad"]]), -7.0)
    texts = ["A bad day. bad, bad! Fine", "fine", "", None, "Bad\nbad\n\nbad x"]
    got = {r["doc_id"]: r["score"] for r in X.toxicity(spark_docs(spark, rows(texts)), model).collect()}
    p = lambda z: 1 / (1 + math.exp(-z))
    want = [1 - (1 - p(-1)) ** 2 * (1 - p(-7)), p(-7), 0, 0, 1 - (1 - p(-1)) ** 3]
    assert all(abs(got[i] - w) < 1e-6 for i, w in enumerate(want))


def test_awkward_tables(spark):
    texts, toxic = data(60)
    docs = spark_docs(spark, [*rows(texts), *rows(awkward(), 100), *rows(["again"] * 2, 5), (None, "x", None, None, None, None, None)])
    labels = labels_of(spark, toxic).union(spark.createDataFrame([(None, 1, 0, ""), (9999, 1, 0, ""), (3, None, 0, ""), (4, 0, 0, "")], LABELS))
    assert X.held_out_toxicity(docs, labels).count() == docs.count()
    assert X.held_out_toxicity(spark_docs(spark, []), labels).count() == 0
    nothing = X.toxicity(docs, X.learn(docs, labels.limit(0), F.lit(True)))
    assert nothing.agg(F.max("score")).first()[0] == 0


def test_long_documents_teach(spark, monkeypatch):
    """Where all toxic documents are long, they are drawn as far as the bytes allow."""
    texts, toxic = data(120)
    texts = [". ".join([t, *["filler words of no harm"] * 700]) if y else t for t, y in zip(texts, toxic)]
    got = X.held_out_toxicity(spark_docs(spark, rows(texts)), labels_of(spark, toxic)).collect()
    assert sum(r["predicted"] != toxic[r["doc_id"]] for r in got) <= 4
    monkeypatch.setattr(X, "MOST_BYTES", 1000)  # no toxic one fits
    model = X.learn(spark_docs(spark, rows(texts)), labels_of(spark, toxic), F.lit(True))
    assert not len(model.weights)
