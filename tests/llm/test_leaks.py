"""Every case that the share of equal words accepts is found."""

import itertools
import random

import numpy as np
import pytest
from llmdata import prose, rows, spark_docs
from test_decontamination import bench, changed, words

from emberscope.llm import decontamination as D


def most_changes(n):
    return n - -(-4 * n // 5)


@pytest.mark.parametrize("n", range(D.LEAST, 2 * D.STRETCH))
def test_masks_survive_all_accepted_changes(n):
    gone = np.array([sum(1 << k for k in c) for c in itertools.combinations(range(n), most_changes(n))])
    hit = np.zeros(len(gone), bool)
    for mask in D.MASKS:
        for s in range(n - mask[-1]):
            hit |= gone & sum(1 << k + s for k in mask) == 0
    assert hit.all()


def test_short_items_are_found_in_whole(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, D.LEAST)]
    texts = [f"a b {t.upper()} c" for _, t in items] + [t for _, t in items] + [f"q {changed(t, [n - 1])} q" for n, t in items]
    got = {(r["doc_id"], r["item_id"], r["n_equal"]) for r in D.overlaps(spark_docs(spark, rows(texts)), bench(spark, items)).collect()}
    assert got == {(i + k * 7, n, n) for k in (0, 1) for i, (n, _) in enumerate(items)}


def accepted(texts, items):
    """(doc, item) with a long enough stretch of enough equal words, by trying every stretch of every alignment."""
    out = set()
    for (d, text), (i, item) in itertools.product(texts, items):
        a, b = np.array(words(text), object), np.array(words(item), object)
        least = min(D.STRETCH, len(b))
        for shift in range(-len(b) + 1, len(a)):
            low, high = max(0, -shift), min(len(b), len(a) - shift)
            if high - low < least:
                continue
            sums = np.concatenate([[0], np.cumsum(5 * (b[low:high] == a[low + shift : high + shift]).astype(int) - 4)])
            if any((sums[k:] >= sums[: len(sums) - k]).any() for k in range(least, len(sums))):
                out.add((d, i))
    return out


def test_every_accepted_change_of_an_item_is_found(spark):
    rng = random.Random(10)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (*range(D.LEAST, D.STRETCH + 1), 15)]
    texts, want = [], set()
    for n, t in items:
        for at in itertools.combinations(range(n), most_changes(n)):
            want.add((len(texts), n))
            texts.append(f"{prose(rng, 3)} {changed(t, at)} {prose(rng, 2)}")
        texts.append(changed(t, range(0, n, n // (most_changes(n) + 1))))
    got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(spark_docs(spark, rows(texts)), bench(spark, items)).collect()}
    assert got == want


def test_all_cases_of_brute_force_and_no_others(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, 8 + i, 300)) for i in range(24)]
    texts = []
    for _, t in items:
        for share in (0.1, 0.2, 0.25, 0.3):
            w = t.split()
            a = rng.randrange(0, max(1, len(w) - 13))
            part = " ".join(w[a : a + rng.randrange(8, 40)])
            n = len(part.split())
            texts.append(f"{prose(rng, 5, 300)} {changed(part, rng.sample(range(n), round(share * n)))} {prose(rng, 4, 300)}")
    got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(spark_docs(spark, rows(texts)), bench(spark, items)).collect()}
    want = accepted(enumerate(texts), items)
    assert got == want and 20 < len(want) < 90
