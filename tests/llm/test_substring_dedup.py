import random
import re

from llmdata import awkward, prose, rows, spark_docs

from emberscope.llm import substring_dedup


def brute(data):
    """(doc_id, n_words, n_removed, kept text) of rows (doc_id, text) with distinct ids."""
    out, seen = {}, set()
    for doc_id, text in sorted(data, key=lambda r: r[0]):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[doc_id] = (len(words), len(gone), " ".join(kept))
    return out


def collect(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()}


def test_matches_brute_force(spark):
    texts = awkward()
    docs = spark_docs(spark).repartition(5)
    assert collect(substring_dedup.repeated_passages(docs)) == brute(enumerate(texts))


def test_passages_of_every_length_and_alignment(spark):
    rng = random.Random(5)
    texts = []
    for k in range(60):
        source = prose(rng, 60, 900)
        words = source.split()
        at, size = rng.randrange(30), rng.randrange(15, 31)
        copy = " ".join(words[at : at + size])
        texts += [f"{prose(rng, k % 17, 900)} {copy} {prose(rng, 5, 900)}", source, copy]
    rng.shuffle(texts)
    docs = spark_docs(spark, rows(texts, 100)).repartition(7)
    assert collect(substring_dedup.repeated_passages(docs)) == brute(enumerate(texts, 100))


def test_stage_changes_texts_and_drops_emptied(spark):
    docs = spark_docs(spark)
    want = {i: (n, gone, text) for i, (n, gone, text) in brute(enumerate(awkward())).items() if not gone or gone < n}
    got = substring_dedup.without_repeats(docs)
    assert got.columns == docs.columns
    original = {r["doc_id"]: r for r in docs.collect()}
    found = {r["doc_id"]: r for r in got.collect()}
    assert set(found) == set(want)
    for i, r in found.items():
        if want[i][1]:
            assert r["text"] == want[i][2] and r["n_chars"] == len(want[i][2])
        else:
            assert r == original[i]


def test_null_and_shared_ids_and_empty_table(spark):
    assert substring_dedup.repeated_passages(spark_docs(spark, [])).count() == 0
    text = prose(random.Random(2), 40, 900)
    one = lambda i, t: (i, t, None, None, None, None, None)
    data = [one(None, text), one(None, f"{text} {text}"), one(4, text), one(4, text), one(9, text), one(9, "short")]
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.repeated_passages(spark_docs(spark, data)).collect())
    assert got == [(0, 0), (0, 40), (4, 0), (4, 0), (9, 0), (9, 40)]
