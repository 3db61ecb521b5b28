import itertools
import random
import re

import numpy as np
from llmdata import awkward, prose, rows, spark_docs

from emberscope.llm import decontamination as D

ITEMS = "item_id long, text string, doc_id string, seed long"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").lower())


def brute(texts, items):
    """(doc, item) to the most equal words of an accepted overlap, by trying every alignment."""
    out = {}
    for (d, text), (i, item) in itertools.product(texts, items):
        a, b = np.array(words(text), object), np.array(words(item), object)
        if len(b) < D.LEAST:
            continue
        for shift in range(-len(b) + 1, len(a)):
            low, high = max(0, -shift), min(len(b), len(a) - shift)
            if high <= low:
                continue
            equal = (b[low:high] == a[low + shift : high + shift]).astype(bool)
            found = D._longest(equal)
            if found and found[1] - found[0] >= min(D.STRETCH, len(b)):
                out[d, i] = max(out.get((d, i), 0), int(equal[found[0] : found[1]].sum()))
    return out


def bench(spark, items):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in items], ITEMS)


def changed(text, at):
    return " ".join("zzz" if k in at else w for k, w in enumerate(text.split()))


def test_masks_survive_any_two_changes():
    for gone in itertools.combinations(range(D.STRETCH), 2):
        assert any(
            not any(m + s in gone for m in mask) for mask in D.MASKS for s in range(D.STRETCH - mask[-1])
        )


def test_overlaps_match_brute_force(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(8, 50), 500)) for i in range(25)]
    items += [(30, None), (31, ""), (32, "too short to find"), (33, items[0][1])]
    texts = [prose(rng, rng.randrange(5, 90), 500) for _ in range(20)]
    for _, item in items[:25]:
        n = len(item.split())
        for k in (0, 1, 2, 4):
            texts.append(f"{prose(rng, rng.randrange(30), 500)} {changed(item.upper(), rng.sample(range(n), k))}\n{prose(rng, 9, 500)}")
        cut = item.split()[rng.randrange(n) :]
        texts.append(" ".join(cut) + " " + prose(rng, 20, 500))
    texts += awkward()
    got = {(r["doc_id"], r["item_id"]): r for r in D.overlaps(spark_docs(spark, rows(texts)).repartition(3), bench(spark, items)).collect()}
    want = brute(enumerate(texts), items)
    sure = {k for k, n in want.items() if n >= D.STRETCH - 2 or n == len(words(dict(items)[k[1]]))}
    assert set(got) <= set(want) and len(sure - set(got)) <= 0.02 * len(sure)
    for key, r in got.items():
        doc, item = words(texts[key[0]]), words(dict(items)[key[1]])
        a, b = doc[r["doc_start"] :][: r["n_words"]], item[r["item_start"] :][: r["n_words"]]
        assert sum(x == y for x, y in zip(a, b)) == r["n_equal"] == want[key] and r["n_equal"] >= 0.8 * r["n_words"]


def test_whole_items_are_always_found(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 13 + i % 30, 500)) for i in range(60)]
    texts = [f"{prose(rng, i % 7, 500)} {changed(t, rng.sample(range(13), i % 3))}" for i, t in items]
    got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(spark_docs(spark, rows(texts)), bench(spark, items)).collect()}
    assert got == {(i, i) for i in range(60)}


def test_stage_and_empty_tables(spark):
    passage = prose(random.Random(1), 20, 500)
    docs = spark_docs(spark, [*rows([f"x {passage} y", "clean text here", None], 3), (None, passage, None, None, None, None, None)])
    left = D.clean(docs, bench(spark, [(1, passage), (None, passage)]))
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 4, 5]
    assert D.clean(docs, bench(spark, [])).count() == 4
    assert D.overlaps(spark_docs(spark, []), bench(spark, [(1, passage)])).count() == 0
