import random
import re

import numpy as np
import xxhash
from llmdata import awkward, prose, rows, spark_docs

from emberscope.llm import simhash
from emberscope.llm.components import components


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_matches_brute_force(spark):
    texts = awkward()
    prints = [brute_print(t) for t in texts]
    want = {(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, brute_components(prints)))}
    assert {tuple(r) for r in simhash.near_duplicates(spark_docs(spark)).collect()} == want


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(simhash, "BUCKET", 40)
    center = rng.getrandbits(64)
    near = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(400)}
    prints = sorted(near | {rng.getrandbits(64) for _ in range(100)})
    table = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    got = {r["node"] & (1 << 64) - 1: r["root"] for r in components(simhash.links(table)).collect()}
    groups = {}
    for p, c in zip(prints, brute_components(prints)):
        groups.setdefault(c, []).append(p)
    mine = {}
    for p in prints:
        mine.setdefault(got.get(p, ("alone", p)), []).append(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (re.findall("[^\x20\x09-\x0d]+", x.lower()) for x in (a, b)))
    return len(a & b) / len(a | b)


def test_set_bits_are_majorities():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 2, 255, 256, 700, 3])
    hashes = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64) * np.uint64(3)
    for got, part, n in zip(simhash._set_bits(hashes, sizes), np.split(hashes, np.cumsum(sizes)[:-1]), sizes):
        assert int(got) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in part) > n)


def test_similar_documents_are_found_and_others_left(spark):
    rng = random.Random(12)
    texts, groups = [], []
    for g in range(60):
        words = prose(rng, rng.randrange(120, 500), 5000).split()
        texts.append(" ".join(words))
        groups.append(g)
        for _ in range(rng.randrange(0, 3)):
            changed = list(words)
            for k in rng.sample(range(len(words)), len(words) // 60):
                changed[k] = f"x{rng.random()}"
            if jaccard(texts[groups.index(g)], " ".join(changed)) >= 0.8:
                texts.append(" ".join(changed))
                groups.append(g)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark_docs(spark, rows(texts))).collect()}
    want = {i: groups.index(g) for i, g in enumerate(groups)}
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want) and len(set(groups)) < len(texts)
    assert all(groups[c] == groups[i] for i, c in got.items())


def test_stage_keeps_one_of_each(spark):
    docs = spark_docs(spark)
    kept = simhash.one_of_each(docs)
    first = {r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == first
    assert simhash.one_of_each(spark_docs(spark, [])).count() == 0


def test_null_ids_repeats_and_empty_table(spark):
    assert simhash.near_duplicates(spark_docs(spark, [])).count() == 0
    data = [(None, "a b c d e f", None, None, None, None, None), *rows(["a b c d e f", "x"], 5), *rows(["x"], 6)]
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(spark_docs(spark, data)).collect())
    assert got == [(-1, 5), (5, 5), (6, 6), (6, 6)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
