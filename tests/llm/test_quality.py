import re
from collections import Counter

from llmdata import awkward, rows, spark_docs

from emberscope.llm import quality


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(fives)
    covered = {i + k for i, f in enumerate(fives) if twice[f] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_stutters": sum(a == b for a, b in zip(words, words[1:])),
    }


def test_measures_match_brute_force(spark):
    texts = [*awkward(), "a | b\n" * 4 + "c", "x\n\n \nx\nx ", "word " * 4, "ö#ö " * 12, "p q r s t " * 2 + "u"]
    got = {r["doc_id"]: r for r in quality.judged(spark_docs(spark, rows(texts))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text)
        assert {k: got[i][k] for k in want} == want
        failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def test_passing_keeps_rows_and_columns(spark):
    docs = spark_docs(spark)
    kept = {r["doc_id"] for r in quality.judged(docs).where("kept").collect()}
    passed = quality.passing(docs)
    assert passed.columns == docs.columns and {tuple(r) for r in passed.collect()} == {tuple(r) for r in docs.collect() if r["doc_id"] in kept}


def test_ablations_count_failures(spark):
    docs = spark_docs(spark)
    entries = quality.ledger(docs)
    ledger = [r["failures"] for r in entries.collect()]
    names = list(quality.RULES)
    for r in quality.ablations(entries).collect():
        mask = sum(1 << names.index(x) for x in quality.POLICIES[r["policy"]])
        bit = 1 << names.index(r["rule"])
        assert r["n_failed"] == sum(bool(f & bit) for f in ledger)
        assert r["n_failed_alone"] == sum(f & mask == bit for f in ledger)
        assert r["n_kept_without"] == sum(not f & mask & ~bit for f in ledger)


def test_empty_table_and_repeated_rows(spark):
    assert quality.judged(spark_docs(spark, [])).count() == 0
    twice = [(None, "a b", None, None, None, None, None)] * 2 + [(7, None, None, None, None, None, None)] * 2
    assert sorted(r["n_words"] for r in quality.judged(spark_docs(spark, twice)).collect()) == [0, 0, 2, 2]
