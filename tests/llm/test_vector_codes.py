import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from emberscope.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"
NAN = float("nan")


def brute(data, parts=8, entries=16, rounds=6, factor=4096):
    """Every distance of every part, in Python integers."""
    kept = [(i, [math.floor(factor * x) for x in v], lab) for i, v, lab in data
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = -(-max(max((len(v) for _, v, _ in kept), default=1), 1) // parts)
    rows = [(i, [(v + [0] * parts * size)[q * size : (q + 1) * size] for q in range(parts)], lab) for i, v, lab in kept]
    books = [[list(r[1][q]) for r in rows[:entries]] for q in range(parts)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(p, e)), k) for k, e in enumerate(books[q])) for q, p in enumerate(r[1])] for r in rows]

    for _ in range(rounds):
        now = assigned()
        for q in range(parts):
            for k in range(len(books[q])):
                own = [r[1][q] for r, a in zip(rows, now) if a[q][1] == k]
                if own:
                    books[q][k] = [sum(c) // len(own) for c in zip(*own)]
    by_label, out = defaultdict(int), []
    for (i, _, lab), a in zip(rows, assigned()):
        error = sum(d for d, _ in a)
        by_label[lab] += error
        out.append((i, "".join(f"{k:02x}" for _, k in a), error, lab))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab], digest) for i, c, e, lab in out), key=str)


def frame(spark, data):
    return spark.createDataFrame([(i, v, lab, "clash", "clash") for i, v, lab in data], SCHEMA)


def as_floats(v):
    return [None if x is None else float(np.float32(x)) for x in v]


def awkward(n=150, width=16, seed=3):
    rng = random.Random(seed)
    data = [(i, as_floats(rng.gauss(0, 1) for _ in range(width)), rng.choice([None, 1, 2])) for i in range(n)]
    data += [(n + i, data[i % 3][1], 1) for i in range(40)]  # copies of three
    data += [(5, data[7][1], 2), (5, data[5][1], None), (None, data[9][1], 2)]  # repeated and null ids
    data += [(900, None, 1), (901, as_floats([None] * width), 1), (902, [NAN] * width, 1), (903, [math.inf] * width, 1)]
    data += [(904, [0.0] * width, 1), (905, [], 2), (906, as_floats([0.5] * (width - 3)), 2), (907, [-0.0001] * width, 2)]
    return data


@pytest.mark.parametrize("width", [16, 20])
def test_equals_a_full_search(spark, width):
    data = awkward(width=width)
    got = vector_codes.compressed(frame(spark, data).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute(data)


def test_few_rows_and_none(spark):
    assert vector_codes.compressed(frame(spark, [])).collect() == []
    assert vector_codes.compressed(frame(spark, [(1, None, 1)])).collect() == []
    few = awkward(3)[:3]
    assert sorted(map(tuple, vector_codes.compressed(frame(spark, few)).collect()), key=str) == brute(few)


def test_bounds_spare_most_distances(spark):
    embeddings = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    measured, books, pivots = vector_codes.prepared(embeddings)
    shares = vector_codes.trained(measured, books, pivots, 6).shares
    assert len(shares) == 6 and max(shares) < 0.6


def test_bounds_never_exceed_distances_of_large_components():
    rng = np.random.default_rng(1)
    top = (1 << 27) - 1
    values = rng.integers(-top, top, (500, 1, 8))
    entries = np.concatenate([values[:8, 0], values[:8, 0]])  # every entry twice: the first one wins
    pivots = entries[None, :4]
    away = vector_codes.pivot_distances(values, pivots).astype(np.float32)[:, 0]
    far = vector_codes.pivot_distances(entries[:, None], pivots)[:, 0]
    found, best, _ = vector_codes.nearest(values[:, 0], away, entries, far)
    every = ((values - entries) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (found == every.argmin(axis=1)).all()


def test_too_large_components_end_with_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        vector_codes.compressed(frame(spark, [(1, [1e9] * 8, 1)])).collect()
