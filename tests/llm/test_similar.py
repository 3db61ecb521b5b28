"""Links of the near-dedup stage against brute-force Jaccard, with pairs on both sides of 0.8."""

import random
import re

from llmdata import prose, rows, spark_docs

from emberscope.llm import simhash


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 9 * shared >= 4 * (len(sets[i]) + len(sets[j])) > 0:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def pairs(rng, n):
    """Texts and copies of them with a changed tail, similar to 0.65 up to 0.95."""
    for k in range(n):
        words = prose(rng, rng.randrange(60, 400), 5000).split()
        size = len(words) - 4
        cut = round(size * (1 - (j := 0.65 + 0.3 * k / n)) / (1 + j))
        yield " ".join(words)
        yield " ".join(words[: len(words) - cut] + [f"x{rng.random()}" for _ in range(cut)])


def components_of(spark, texts):
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark_docs(spark, rows(texts)).repartition(3)).collect()}
    return [got[i] for i in range(len(texts))]


def test_links_are_exact_on_both_sides(spark):
    texts = [*pairs(random.Random(5), 150), None, "", "one two", "one  TWO", "one two three"]
    want = brute(texts)
    assert components_of(spark, texts) == want
    assert 60 < sum(want[i] == want[i - 1] for i in range(1, 300, 2)) < 90


def test_chains_and_groups_of_many_cells(spark, monkeypatch):
    rng = random.Random(6)
    words, texts = prose(rng, 120, 5000).split(), []
    for k in range(60):  # a chain whose ends share nothing
        texts.append(" ".join(words))
        for _ in range(2 if k % 7 else 12):
            words[rng.randrange(len(words))] = f"y{rng.random()}"
    want = brute(texts)
    assert len(set(want)) > 1 and len(set(want)) < 40
    monkeypatch.setattr(simhash, "CELL", 1500)
    assert components_of(spark, texts) == want


def test_blocks_alone_find_most_close_pairs_and_no_strangers(spark):
    """What the fingerprints propose before the bands add theirs."""
    rng = random.Random(9)
    texts = []
    for k in range(200):
        words = prose(rng, 300, 5000).split()
        size = len(words) - 4
        cut = round(size * 0.05)  # similar to 0.9
        texts += [" ".join(words), " ".join(words[: len(words) - cut] + [f"x{rng.random()}" for _ in range(cut)])]
    docs = spark_docs(spark, rows(texts)).select("doc_id", "text")
    prints = docs.mapInArrow(simhash._band_batches, "doc_id long, node long, keys array<long>, prints array<long>").cache()
    of = {r["node"]: r["doc_id"] for r in prints.select("doc_id", "node").collect()}
    found = {frozenset((of[r["a"]], of[r["b"]])) for r in simhash.block_candidates(prints.drop("doc_id")).collect()}
    assert all(a // 2 == b // 2 for a, b in map(sorted, found))
    assert len(found) > 160


def test_a_bucket_of_many_copies_goes_on_once_a_batch():
    import numpy as np
    import pyarrow as pa

    n = 1000
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * simhash.BANDS), pa.array(np.tile(np.arange(simhash.BANDS), n)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), lists], ["node", "values"])
    on, links = list(simhash._met(iter([batch]), False))
    assert on.num_rows == simhash.BANDS and set(on.column(1).to_pylist()) == {0}
    assert sorted(zip(links.column(1).to_pylist(), links.column(2).to_pylist())) == [(i, 0) for i in range(1, n)]
