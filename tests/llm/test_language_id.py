import itertools

import numpy as np
import pyarrow as pa
from llmdata import awkward, rows, spark_docs
from pyspark.sql import functions as F

from emberscope.llm import language_id as L

ENGLISH = "the quick brown fox jumps over the lazy dog and then the other thing with this one "
GERMAN = "der schnelle braune Fuchs springt über den faulen Hund und dann noch ein anderes Ding "
RUSSIAN = "быстрая коричневая лиса прыгает через ленивую собаку и потом ещё раз "


def corpus(spark):
    return spark.createDataFrame([("en", ENGLISH * 5), ("de", GERMAN * 5), ("ru", RUSSIAN * 5)], "lang string, text string")


def docs_of(spark, texts):
    return spark_docs(spark, rows(texts))


def test_labelling_is_the_best_of_all():
    rng = np.random.default_rng(1)
    bounds = np.array([0, 5, 5, 6, 12])
    scores = rng.normal(size=(12, 3)) * 3
    found = L.labelling(scores, bounds, 2.0)
    for a, b in zip(bounds[:-1], bounds[1:]):
        value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: E731, B023
        if b > a:
            best = max(map(value, itertools.product(range(3), repeat=b - a)))
            assert abs(value(tuple(found[a:b])) - best) < 1e-9


def test_spans_of_mixed_text(spark):
    model = L.learn(corpus(spark))
    texts = [ENGLISH, GERMAN * 2, RUSSIAN, ENGLISH + GERMAN * 3 + RUSSIAN, None, "", "12 , !", "日本", "x", "× ÷ ×"]
    got = {r["doc_id"]: r for r in L.languages(docs_of(spark, texts), model).collect()}
    assert [got[i]["lang_pred"] for i in range(7)] == ["en", "de", "ru", "de", "und", "und", "und"]
    assert got[7]["lang_pred"] in model.labels and got[8]["lang_pred"] in model.labels and got[9]["lang_pred"] == "und"
    mixed = [(s["lang"], s["first_word"], s["n_words"]) for s in got[3]["spans"]]
    n = [len(t.split()) for t in (ENGLISH, GERMAN * 3, RUSSIAN)]
    assert mixed == [("en", 0, n[0]), ("de", n[0], n[1]), ("ru", n[0] + n[1], n[2])]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[0]["score"] == 1 and got[4]["score"] == 0


def test_script_keeps_other_languages_out(spark):
    model = L.learn(corpus(spark))
    got = L.languages(docs_of(spark, ["щщщ ъъъ эээ", "zzz qqq"]), model).collect()
    assert got[0]["lang_pred"] == "ru" and got[1]["lang_pred"] != "ru"


def test_held_out_rows_are_not_learned(spark):
    data = [(i, "aaaa bbbb cccc", "xx", None, None, None, None) for i in range(40)]
    docs = spark_docs(spark, data).withColumn("lang", F.when(L.fold(F.col("doc_id"), 4) == 2, "secret").otherwise("xx"))
    got = L.held_out_languages(docs).collect()
    assert {r["lang_pred"] for r in got} == {"xx"} and 0 < sum(r["held_out"] for r in got) < 40


def test_awkward_texts_and_empty_table(spark):
    docs = docs_of(spark, awkward())
    got = L.held_out_languages(docs).collect()
    assert len(got) == docs.count() and {r["lang_pred"] for r in got} == {"en", "und"}
    assert L.held_out_languages(spark_docs(spark, [])).count() == 0
    nothing = L.languages(docs, L.learn(corpus(spark).limit(0)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows_ = L.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows_) >= 0.97 * len(rows_)


def test_stretches_of_a_long_text_change_nothing(spark, monkeypatch):
    model = L.learn(corpus(spark))
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([ENGLISH, GERMAN, RUSSIAN, "12 , ! "], 12)) for _ in range(6)] + ["", None, "  \t ", "x" * 300, "日" * 200]
    want = [tuple(r) for r in L.languages(docs_of(spark, texts), model).orderBy("doc_id").collect()]
    for k, name in ((1, "_HELD"), (150, "_LEAST"), (100, "_STRETCH")):
        monkeypatch.setattr(L, name, k)
    of = L.bytes_of(pa.array([texts[0]]))
    parts = list(L._long_text(of))
    assert len(parts) > 5 and b"".join(p.data.tobytes() for p in parts) == texts[0].encode()
    scores = [model.word_scores(L.Grams(p)) for p in parts]
    whole = L.labelling(np.concatenate(scores), np.array([0, sum(map(len, scores))]))
    assert (L.labelled_stretches(scores, 3) == whole).all() and len(set(whole.tolist())) == 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t or "" for t in texts])], ["doc_id", "text"])
    shared = spark.sparkContext.broadcast(model)
    found = [tuple(r.values()) for b in L._label(iter([batch]), shared) for r in b.to_pylist()]
    assert [(i, lang, share) for i, lang, share, _ in found] == [(i, lang, share) for i, lang, share, _ in want]
    assert [[tuple(s.values()) for s in spans] for *_, spans in found] == [[tuple(s) for s in spans] for *_, spans in want]
